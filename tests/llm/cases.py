"""Documents with nulls, empty and long texts, ties, repeated rows and columns whose names clash with outputs."""

#: Names that operators use inside, or used to.
INSIDE = "id row pos line h1 h2 first last n salt gone shard rank before p m grp __id __row __grp __shard __rank __before __p __m __x hits x t a b fp root Part".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n_words string, kept_text string, " + ", ".join(f"{c} int" for c in INSIDE)
LONG = " ".join(f"word{i % 977} filler{i % 13}" for i in range(60_000))


def odd(spark):
    line = "A line that is long enough to count"
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [
        (1, line + "\nown line number one\n\n" + passage, "en"),
        (2, "  " + line.upper() + "\t\nother line of two", "en"),
        (3, None, None),
        (4, "", "de"),
        (5, "   \n\t \n", "de"),
        (6, LONG, "fr"),
        (6, LONG, "fr"),
        (7, "short", None),
        (8, line + "\nown line number one\n\n" + passage, "en"),
        (9, "Ünïcödé ÄÖÜ ß 漢字 \U0001f600 " + passage, "es"),
        (None, line + "\nnobody's line", "en"),
        (None, None, None),
        (10, "1234 5678 --- !!!", "en"),
        (11, "x" * 700 + " " + passage[5:], "en"),
        (12, passage, "en"),
        (12, "a second row of twelve " + passage, "en"),
    ]
    return spark.createDataFrame([(i, t, lang, "s", -1, "clash", "clash", "clash", *range(len(INSIDE))) for i, t, lang in rows], SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def same_columns(out, docs, more):
    assert sorted(out.columns) == sorted({*docs.columns, *more})
    kept = [c for c in INSIDE if c not in more]
    assert {tuple(r) for r in out.select(*kept).collect()} == {tuple(INSIDE.index(c) for c in kept)}
