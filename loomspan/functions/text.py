"""Text, id and date functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a token is, and the code points that count as CJK.
ASCII_TOKEN = r"[a-z0-9][a-z0-9_.:/+-]+"
CJK = r"[一-鿿]"
PLAYBOOK_TOKEN = r"[a-z0-9][a-z0-9_./+-]{1,80}|[一-鿿]{2,}"
MISSING_TEXTS = ("", "nan", "null", "none", "无", "-")
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd", "yyyyMMdd")


def present(c: Column) -> Column:
    """The value, or null where it is missing or empty."""
    return F.when(F.trim(c) != "", c)


def first_present(*cols: Column) -> Column:
    """The first of several aliases of a field that holds something."""
    return F.coalesce(*map(present, cols))


def normalize_text(c: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def normalize_query(c: Column) -> Column:
    """Lower case without white space and common ASCII and CJK punctuation."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[\s,，。.;；:：!！?？、]+", "")


def squash_query(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", "")


def playbook_query(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9一-鿿_./+-]+", " "))


def benchmark_text(c: Column) -> Column:
    """Lower case letters, digits and underscores only (of any script)."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+", "")


def valid_text(c: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(*MISSING_TEXTS)


def text_tokens(c: Column) -> Column:
    """ASCII words of two or more characters, then CJK characters, then pairs of neighbouring CJK characters."""
    low = F.lower(F.coalesce(c, F.lit("")))
    words = F.regexp_extract_all(low, F.lit(ASCII_TOKEN), F.lit(0))
    one = F.regexp_extract_all(low, F.lit(CJK), F.lit(0))
    return F.concat(words, with_runs(one, 2))


def with_runs(chars: Column, *sizes: int) -> Column:
    """The characters, then their runs of the given sizes. The array is made once, being the item of an array of one."""
    run = lambda o, n: F.transform(F.sequence(F.lit(1), F.size(o) - n + 1), lambda k: F.array_join(F.slice(o, k, n), ""))
    none = F.array().cast("array<string>")
    return F.flatten(F.transform(F.array(chars), lambda o: F.concat(o, *[F.when(F.size(o) >= n, run(o, n)).otherwise(none) for n in sizes])))


def playbook_tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(PLAYBOOK_TOKEN), F.lit(0)))


def lexical_tokens(c: Column) -> Column:
    """``playbook_tokens``, with the runs of two and three characters of CJK tokens of three or more after each; each once."""
    chars = lambda t: F.filter(F.split(t, ""), lambda x: x != "")
    runs = lambda t: F.concat(F.array(t), F.slice(with_runs(chars(t), 2, 3), F.length(t) + 1, F.greatest(2 * F.length(t) - 3, F.lit(0))))
    return F.array_distinct(F.flatten(F.transform(playbook_tokens(c), lambda t: F.when(t.rlike("^[一-鿿]{3,}$"), runs(t)).otherwise(F.array(t)))))


def stable_id(*cols: Column, length: int = 24) -> Column:
    """Leading digits of the SHA-1 of the parts, one a line; a null part counts as the text None."""
    return F.substring(F.sha1(F.concat_ws("\n", *[F.coalesce(c.cast("string"), F.lit("None")) for c in cols])), 1, length)


def selection_key(seed: int | str, *cols: Column) -> Column:
    """A digest that orders rows at random but always alike."""
    return F.sha2(F.concat_ws("\n", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256)


def truncated(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def parsed_date(c: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS]).cast("date")


def id_text(c: Column) -> Column:
    """Ids that spreadsheets turned into numbers lose their fraction."""
    return F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")


def split_values(c: Column, sep: str = r"[,，/、]") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), sep), lambda x: F.trim(x)), lambda x: x != "")


def token_estimate(c: Column) -> Column:
    """Tokens of a text by rule of thumb: CJK characters / 1.8 plus others / 3.6."""
    cjk = F.regexp_count(F.coalesce(c, F.lit("")), F.lit(CJK))
    return F.ceil(cjk / 1.8 + (F.length(F.coalesce(c, F.lit(""))) - cjk) / 3.6)


def integer_answer(c: Column) -> Column:
    """The integer on the last line of the form ``#### n``, canonical; null if there is none or it is malformed."""
    raw = F.regexp_extract(c, r"####\s*([+-]?(?:\d{1,3}(?:,\d{3})+|\d+))\s*$", 1)
    plain = F.regexp_replace(F.regexp_replace(raw, ",", ""), r"^\+", "")
    canonical = F.regexp_replace(F.regexp_replace(plain, r"^(-?)0+(?=\d)", "$1"), "^-0$", "0")
    return F.when(raw != "", canonical)


def last_integer(c: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"-?\d+"), F.lit(0))
    return F.try_element_at(found, F.lit(-1))


def queries_equivalent(a: Column, b: Column) -> Column:
    """Whether two queries say the same but for case and white space; empty ones say nothing."""
    x, y = squash_query(a), squash_query(b)
    return (x != "") & (x == y)


def split_tokens(c: Column) -> Column:
    """Runs of ASCII letters, digits and CJK characters, lower case."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^0-9a-z一-鿿]+"), lambda x: x != "")


def clean_text(c: Column) -> Column:
    """Control and invisible characters go, middle dots become spaces, white space runs one space; spaces beside CJK characters go."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}\x{AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}]", "")
    one = F.trim(F.regexp_replace(F.translate(bare, "·", " "), r"\s+", " "))
    return F.regexp_replace(one, r"(?<=[一-鿿]) | (?=[一-鿿])", "")


def eos_trimmed(ids: Column, eos: int) -> Column:
    """Token ids up to the first end mark, which goes too."""
    at = F.array_position(ids, F.lit(eos)).cast("int")
    return F.when(at > 0, F.slice(ids, 1, F.greatest(at - 1, F.lit(0)))).otherwise(ids)


def without_prefix_hint(c: Column, prefix: str) -> Column:
    """The text without a hint that begins with ``prefix`` and reaches to the next quote that no backslash escapes."""
    import re

    return F.regexp_replace(c, re.escape(prefix) + r'(?:[^"\\]|\\.)*', "")


def source_of_id(c: Column, kinds: dict[str, str], other: str = "document") -> Column:
    """The kind of source that an evidence id tells by the part before its first colon or dash."""
    head = F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), r"^([^:\-]*)", 1))
    return F.coalesce(*[F.when(head == k, v) for k, v in kinds.items()], F.lit(other))


def names_platform(text: Column, platform: str) -> Column:
    """Whether a text names a platform: names of up to three characters stand between other signs, longer ones anywhere."""
    import re

    low, name = F.lower(F.coalesce(text, F.lit(""))), platform.lower()
    return low.rlike(rf"(?:^|[^a-z0-9]){re.escape(name)}(?:$|[^a-z0-9])") if len(name) <= 3 else F.contains(low, F.lit(name))
