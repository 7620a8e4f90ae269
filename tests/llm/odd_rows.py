"""Rows (doc_id, text) that are hard on every operator: nulls, empty and long texts, ties, repeats."""

LONG = " ".join(f"w{i * i % 977} v{i % 31}" for i in range(30_000))
ODD = [(None, None), (None, "a null id with a few words more"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (5, LONG), (6, "tied"), (7, "tied"), (8, "ünï·çødé 𝄞 ſ İ\x00\x01   x")]
