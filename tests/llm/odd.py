"""Odd tables: nulls, empty and very long texts, ties, repeated rows, clashing columns; and SQL over DataFrames."""

import duckdb
from oracle_compare import rows

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards boil tea in copper kettles".split()
PASSAGE = "this passage of the corpus is repeated word for word in several documents, which is why it should be found by the search"
LONG = " ".join(f"w{i % 977}" for i in range(40_000)) + "\n" + "x" * 5000

#: (doc_id, text, lang, source)
ODD = [
    (1, None, "en", "a"),
    (2, "", None, "a"),
    (3, " \n\t\n ", "en", None),
    (4, "\n".join([PASSAGE, "own line of number four is here"]), "en", "a"),
    (5, "\n".join(["another start", PASSAGE.upper(), "end"]), "en", "a"),
    (6, "  " + PASSAGE + "  ", "en", "b"),
    (7, "\n".join([PASSAGE, PASSAGE, "seven"]), "fr", "a"),
    (8, LONG, "en", "a"),
    (9, LONG + " changed", "en", "a"),
    (10, "Ünïcödé ß…  naïve café — ☃ don't <|endoftext|> 12,5 % 中文", "de", "a"),
    (11, "one", "en", "a"),
    (12, "one\ttwo", "en", "a"),
    (13, "one two", "en", "a"),
    (14, "a b c d e f g h i j", "en", "a"),
    (15, " ".join(WORDS * 4), "en", "a"),
    (16, " ".join([*WORDS * 4, "end"]), "en", "c"),
    (17, "#### $$$ &&& *** ||| <<< >>> %%% ### $$$ ### ***", "en", "c"),
    (18, "0123 4567 89", "en", "c"),
    (None, "row without an id " * 9, "en", "a"),
]
#: A row that is there twice, whole.
TWICE = [(20, "twice here with quite a few words of its own that no other row has, so nothing but the common part can go: " + PASSAGE, "en", "a")] * 2


def frame(spark, data, partitions=3, clashing=True):
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string").repartition(partitions)
    if clashing:
        names = "kept keep_id sha salt content group_size rank class pos label node sig gone carried slot block digest bucket score rule verdict piece listed spans n_shingles component_id lang_pred held_out kept_id text_hash stretch grp weight key single row"
        for name in names.split():
            df = df.selectExpr("*", f"'{name}' AS {name}")
    return df


def sql_rows(query, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    rel = con.execute(query)
    names = [d[0] for d in rel.description]
    return rows(names, rel.fetchall())


def got_rows(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])

