"""Listings, crawls, loads, chunks and reading order against plain versions on small fixtures."""

import random

import pytest

from sparkloom.operators import documents, fail_loud, knowledge, pdf
from sparkloom.sources import collect, sinks


def test_ignore_rules(spark):
    paths = ["a.log", "keep.log", "build/x.rs", "src/build.rs", "private/a", "x/private/b/c", "top/e.tmp", "x/top/e.tmp", ".git/config", "docs/a/b.md", "docs/b.md", "out/a.py"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    rules = ("*.log", "!keep.log", "private/", "/top/*.tmp", "docs/**/b.md", "# no", "")
    assert {r.path for r in collect.kept(files, rules).collect()} == {"keep.log", "src/build.rs", "x/top/e.tmp"}
    assert {r.path for r in collect.kept(files, (), hidden=True, skip=()).collect()} == set(paths)
    with pytest.raises(ValueError):
        collect.glob_regex("../x")


def test_tag_hierarchies():
    assert collect.hierarchy("tools:\n  - hammer\n  - saw\ncolours: [red, 'blue']\n") == [("hammer", "tools"), ("saw", "tools"), ("red", "colours"), ("blue", "colours")]
    assert collect.hierarchy("- child: a\n  parent: b\n- child: c\n  parent: b\n") == [("a", "b"), ("c", "b")]
    for wrong in ("a:\n  - a\n", "p: [" + ",".join(f"c{k}" for k in range(1001)) + "]", "x" * 70_000):
        with pytest.raises(ValueError):
            collect.hierarchy(wrong)


def test_module_specifications():
    found = collect.modules_toml("[modules.b]\nseeds = ['x']\n[modules.a]\ndescription = 'd'\ninclude = ['y*']\n")
    assert found == [("a", "d", [], ["y*"], []), ("b", "", ["x"], [], [])]


def test_crawl_of_captured_pages(spark):
    rng = random.Random(4)
    urls = [f"https://h{k % 3}.org/p{k}" for k in range(60)]
    links = [(rng.choice(urls), rng.choice([*urls, "https://gone.org/x"])) for _ in range(300)]
    pages, frame = spark.createDataFrame([(u,) for u in urls], "url string"), spark.createDataFrame(links, "url string, target string").distinct()
    found = {(r.start, r.url, r.depth) for r in collect.crawl(pages, frame, pages.limit(60), 2, 5).collect()}
    want = set()
    for start in urls:
        seen, ahead = {start: 0}, [start]
        for depth in (1, 2):
            ahead = sorted({t for u, t in links if u in ahead and t in urls and t.split("/")[2] == start.split("/")[2]} - set(seen))
            seen.update(dict.fromkeys(ahead, depth))
        want |= {(start, u, d) for u, d in sorted(seen.items(), key=lambda x: (x[1], x[0]))[:5]}
    assert found == want


def test_tables_are_replaced_and_logs_cleared(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.append_log(spark.range(3), path)
    sinks.append_log(spark.range(2), path)
    assert spark.read.parquet(path).count() == 5
    sinks.replace_table(spark.range(4), path)
    assert spark.read.parquet(path).count() == 4
    sinks.clear_log(spark.range(4), path)
    assert spark.read.parquet(path).count() == 0 and spark.read.parquet(path).columns == ["id"]


def test_csv_lines(spark):
    rows = spark.createDataFrame([("a,b", 1, 0.12345), ('c"d', None, 2.0)], "x string, n int, f double")
    assert {r.value for r in sinks.csv_lines(rows, "x").collect()} == {'"a,b",1,0.123', '"c""d",,2.000'}


def test_node_chunks_against_greedy_filling(spark):
    rng = random.Random(6)
    rows = [(b, p, rng.randint(1, 60)) for b in range(4) for p in range(rng.randint(1, 50))]
    found = {(r.batch, r.pos): r.chunk for r in documents.chunks(spark.createDataFrame(rows, "batch long, pos long, bytes long"), 100, 5).collect()}
    for b in range(4):
        chunk, held = 0, []
        for _, p, size in sorted(r for r in rows if r[0] == b):
            if held and (sum(held) + size > 100 or len(held) == 5):
                chunk, held = chunk + 1, []
            held.append(size)
            assert found[b, p] == chunk


def box(page, k, left, bottom, right, top):
    return (page, k, float(left), float(bottom), float(right), float(top))


def test_reading_order_of_known_pages(spark):
    columns = [box(1, k, 10 if k < 3 else 200, 300 - 40 * (k % 3), 150 if k < 3 else 340, 330 - 40 * (k % 3)) for k in range(6)]
    header = [box(2, 9, 10, 700, 600, 720), *[(2, *b[1:]) for b in columns]]
    footer = [box(3, 9, 10, 5, 600, 15), *[(3, *b[1:]) for b in columns]]
    rows = [*columns, *header, *footer, box(4, 1, 0, 0, 10, 10), box(4, 2, 2, 2, 8, 8)]
    found = {}
    for r in pdf.reading_order(spark.createDataFrame(rows, "page long, id long, left double, bottom double, right double, top double")).collect():
        found.setdefault(r.page, {})[r.rank] = r.id
    order = {p: [ids[k] for k in sorted(ids)] for p, ids in found.items()}
    assert order == {1: [0, 1, 2, 3, 4, 5], 2: [9, 0, 1, 2, 3, 4, 5], 3: [0, 1, 2, 3, 4, 5, 9], 4: [1, 2]}


def test_failures_that_code_hides(spark):
    files = [
        ("a.py", "try:\n    x()\nexcept A:\n    pass\nexcept B:\n    raise\n"), ("b.rs", "fn f() {\n  if let Err(e) = g() {\n    return Ok(());\n  }\n  let _ = tx.send(1);\n}"),
        ("c.go", "if err != nil {\n  return fmt.Errorf(1)\n}"), ("d.js", "p.catch(e => [])\ntry { x } catch (e) {\n  throw e\n}"), ("e.ex", "case f() do\n  {:error, _} -> {:ok, []}\nend"),
        ("f.java", "try { a(); } catch (E e) {\n  return false;\n}"), ("tests/g.py", "try:\n  x()\nexcept A:\n  pass\n"), ("h.py", "not python ("), ("i.rs", None), (None, "x"),
    ]
    found = {(r.path, r.line, r.finding) for r in fail_loud.findings(spark.createDataFrame(files, "path string, text string")).collect()}
    assert found == {("a.py", 3, "python_except_default"), ("b.rs", 2, "rust_iferr_ok_default"), ("b.rs", 5, "rust_ignored_fallible"), ("d.js", 1, "js_promise_catch_default"), ("e.ex", 2, "elixir_error_ok_default"), ("f.java", 1, "jvm_dotnet_catch_default")}


def test_positions_in_three_encodings(spark):
    text = "aé😀b\nxy"
    rows = [(line, k) for line in range(3) for k in range(8)]
    frame = spark.createDataFrame(rows, "line int, k int")
    from pyspark.sql import functions as F

    out = {(r.line, r.k): (r.u8, r.u16, r.u32) for r in frame.select("line", "k", *(knowledge.position_to_byte(F.lit(text), F.col("line"), F.col("k"), e).alias(n) for e, n in (("utf-8", "u8"), ("utf-16", "u16"), ("utf-32", "u32")))).collect()}
    for line, k in rows:
        want = []
        for width in (lambda c: len(c.encode()), lambda c: len(c.encode("utf-16-le")) // 2, lambda c: 1):
            parts = ["aé😀b\n", "xy"]
            at = None
            if line < 2:
                n = 0
                for j in range(len(parts[line]) + 1):
                    if n == k:
                        at = len("".join(parts[:line]).encode()) + len(parts[line][:j].encode())
                        break
                    n += width(parts[line][j]) if j < len(parts[line]) else 0
            want.append(at)
        assert out[line, k] == tuple(want)
