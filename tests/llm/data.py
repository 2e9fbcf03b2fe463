"""Small tables with every awkward case: nulls anywhere, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(n=60, seed=5, awkward=True):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß日") for _ in range(r.randint(1, 6))) for _ in range(300)]
    sentence = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    rows = []
    for i in range(n):
        text = sentence(r.choice([3, 5, 25, 60, 120]))
        if i % 4 == 1:
            w = rows[-1][1].split(" ")
            for _ in range(r.choice([0, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            text = " ".join(w) if i % 8 else " ".join(w).upper()
        if i % 10 == 3:
            text = "\n".join([sentence(9)] * 3 + [" \t", text])
        rows.append((i, text, r.choice(["en", "de", None]), r.choice(["a", "b", "c", "B", None]), len(text)))
    if awkward:
        rows += [(n, None, "en", "a", None), (n + 1, "", None, None, 0), (n + 2, " \n\x0b ", "en", "b", 4), (n + 3, "x" * 5000 + " " + sentence(3000), "en", "c", 9)]
        rows += [rows[2], rows[2], (None, rows[5][1], "en", "a", 1), (None, None, None, None, None), (n + 4, rows[4][1], "en", "zz", 1)]
    return rows


def frame(spark, rows, extra=True):
    d = spark.createDataFrame(rows, DOCS)
    if extra:  # columns that operators use inside
        for c in ("size", "shard", "slot", "_bucket", "rank", "row", "t", "words", "item_id", "quality", "node", "label"):
            d = d.selectExpr("*", f"'mine' AS `{c}`")
    return d
