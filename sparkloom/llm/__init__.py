"""Training-data operators: secrets, packing, repeats, quality, near copies, chat, leaks, personal data, licences."""
