import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": "the of and to in is that it for was on with be by thing under over river stone house".split(),
    "fr": "le la les des une est que dans pour pas sur avec plus maison rivière étoile où être très déjà".split(),
    "de": "der die das und ist nicht mit ein eine für auf über straße schön größe haus wasser baum gehen weiß".split(),
}


def prose(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    return " ".join(r.choice(WORDS[lang]) + (r.choice("abcdefgh") * r.randint(0, 2)) for _ in range(n))


def corpus(n=60):
    """Documents with nulls, empty and long texts, exact and near copies, repeated rows and a dominating source."""
    rows = []
    for i in range(n):
        lang = ("en", "fr", "de")[i % 3]
        rows.append((i, prose(lang, 30 + 7 * (i % 9), i), lang, "hot" if i % 3 else f"s{i % 5}", 1))
    base = rows[4][1].split()
    for k in range(6):
        near = list(base)
        near[k * 3] = "changed"
        rows.append((200 + k, " ".join(near), "fr", "hot", 1))
    rows += [(300 + k, rows[7][1], "fr", "hot", 1) for k in range(4)]
    rows += [(400, None, None, None, None), (401, "", "en", "hot", 0), (402, "?! 123", None, "s1", 3), (403, prose("en", 4000, 1), "en", "s1", 1), (404, "one two", "en", None, 1)]
    rows += [rows[3], rows[3]]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)


def extra(df):
    """The same rows with columns whose names operators use."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in ("size", "shard", "slot", "score", "lang_pred", "n_spans", "spans", "id", "rep", "path", "links", "target")})
