"""Helpers of the training-data operator tests."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, key string, score double"


def docs_frame(spark, rows):
    """Rows (doc_id, text, lang, source) with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, la, so, None if t is None else len(t), 99, "k", 0.5) for i, t, la, so in rows], DOCS)


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def components(ids, links):
    """Smallest member by union of linked keys."""
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = top(a), top(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}
