"""Personal data: patterns, and terms that disclose a found entity by what the corpus tells about them."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import steps, stored

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")
NUMBER = re.compile(r"[^0-9]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of a local part, an at sign and a domain with a dot, found from the at signs."""
    at, last = text.find("@"), 0
    while at >= 0:
        m = DOMAIN.match(text, at)
        if m:
            start = at
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                last = m.end()
        at = text.find("@", max(at + 1, last))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers with dots between, at most 255 each. A chain of more numbers holds a match for each four of them."""
    for m in NUMBERS.finditer(text):  # whole chains of numbers, so that no digit is looked at twice
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(n := p.lstrip("0")) <= 3 and int(n or 0) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each pattern match that holds, by start and then kind; each kind is matched by itself."""
    out = [(s, e, 0) for s, e in emails(text)] if "@" in text else []
    out += [(s, e, 1) for s, e in addresses(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := NUMBER.sub("", m[0])) <= 19 and luhn(d):
            out.append((*m.span(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NUMBER.sub("", m[0])) <= 15:
                out.append((*m.span(), 3))
    return [(s, e, KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2], x[1]))]


def told(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def terms(text: str) -> set[str]:
    return {w.lower() for w in set(TERM.findall(text))}


def free_terms(text: str, base: str) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of every term that lies in no pattern match."""
    taken = sorted((int(s), int(e)) for _, s, e in (x.split(":") for x in base.split(",") if x))
    k = last = 0
    for m in TERM.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            last, k = max(last, taken[k][1]), k + 1
        if last <= m.start():
            yield m[0].lower(), m.start(), m.end()


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: matches, the keys of the entities matched, and the text itself where there is one."""
    for batch, texts in steps(batches, "__text"):
        rows: dict[str, list] = {c: [] for c in ("n_email", "n_ip", "n_card", "n_phone", "base", "base_sha256", "entities", "text")}
        for text in texts:
            spans = base_spans(text)
            names = [k for _, _, k in spans]
            for k in KINDS[:4]:
                rows[f"n_{k}"].append(names.count(k))
            base = told(spans)
            rows["base"].append(base)
            rows["base_sha256"].append(hashlib.sha256(base.encode()).hexdigest())
            rows["entities"].append(sorted({key64(f"{kind}:{text[s:e].lower()}") for s, e, kind in spans}))
            rows["text"].append(text if spans else None)
        types = {"entities": pa.list_(pa.int64()), "base": pa.string(), "base_sha256": pa.string(), "text": pa.string()}
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, types.get(c, pa.int64())) for c, v in rows.items()]], ["__key", *rows])


def key64(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def entity_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entity, term, n) over the texts seen: in how many both occur, summed as far as memory goes."""
    yield from counted(((e, t) for batch in batches for text, base, entities in zip(*(batch.column(c).to_pylist() for c in ("text", "base", "entities")), strict=True) for t in {t for t, _, _ in free_terms(text, base)} for e in entities), ("entity", "term"))


def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): in how many of the texts seen each term occurs."""
    yield from counted(((t,) for _, texts in steps(batches, "__text") for text in texts for t in terms(text)), ("term",))


def counted(keys: Iterator[tuple], names: tuple[str, ...], most: int = 400_000) -> Iterator[pa.RecordBatch]:
    """How often each key comes; beyond ``most`` different ones the counts so far are handed on, to be summed up later."""
    types = {"entity": pa.int64(), "term": pa.string()}

    def out(n: Counter) -> pa.RecordBatch:
        cols = [pa.array([k[i] for k in n], types[name]) for i, name in enumerate(names)]
        return pa.RecordBatch.from_arrays([*cols, pa.array(n.values(), pa.int64())], [*names, "n"])

    n: Counter = Counter()
    for part in iter(lambda: list(islice(keys, 100_000)), []):
        n.update(part)
        if len(n) > most:
            yield out(n)
            n.clear()
    if n:
        yield out(n)


def term_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: where its disclosing terms stand."""
    for batch in batches:
        places = [[{"start": s, "end": e} for t, s, e in free_terms(text, base) if t in known] for text, base, known in zip(batch.column("text").to_pylist(), batch.column("base").to_pylist(), map(set, batch.column("telling").to_pylist()), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(places, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["row", "places"])


def find_personal_data(docs: DataFrame, min_docs: int = 2, disclosure: float = 0.9, share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pattern matches of each text, and terms of the same text that disclose them.

    Information-theoretic sanitisation: the matched values are the protected entities. For every term of a document with a match,
    wherever it stands, the corpus tells in how many documents the term, the entity and both occur. A term discloses an entity when
    the normalised pointwise mutual information log(N n(e,t) / (n(e) n(t))) / -log(n(e,t) / N) is at least ``disclosure``, at least
    the share ``share`` of the term's documents have the entity, and both are in ``min_docs`` documents or more; entities in fewer
    documents are not paired with terms at all. All occurrences of the term in the entity's documents become spans of kind ``term``. All
    counts are over the whole corpus; frequent terms and entities are counted by partial sums.

    Null texts count as empty. Rows are handled one by one, also where ids repeat. Returns the id, n_email, n_ip, n_card,
    n_phone, base_sha256, spans (all of them, ``kind:start:end``), n_term.
    """
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row")).alias("__key"), F.col(text_col).alias("__text"))
    kind = docs.schema[id_col].dataType.simpleString()
    found = stored(keyed.mapInArrow(scan, f"__key struct<id:{kind},row:long>, n_email long, n_ip long, n_card long, n_phone long, base string, base_sha256 string, entities array<long>, text string"))
    of_rows = found.select(F.col("__key.row").alias("row"), F.explode("entities").alias("entity"))
    entities = stored(of_rows.groupBy("entity").agg(F.count("*").alias("n_entity")).filter(F.col("n_entity") >= min_docs))
    held = stored(of_rows.join(entities, "entity").select("row", "entity"))
    texts = found.filter(F.col("text").isNotNull()).select(F.col("__key.row").alias("row"), "text", "base")
    paired = texts.join(held.groupBy("row").agg(F.collect_list("entity").alias("entities")), "row").select("text", "base", "entities")
    both = paired.mapInArrow(entity_terms, "entity long, term string, n long").groupBy("entity", "term").agg(F.sum("n").alias("n_both")).filter(F.col("n_both") >= min_docs)
    terms = docs.select(F.col(text_col).alias("__text")).mapInArrow(document_counts, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term")).filter(F.col("n_term") >= min_docs)
    total = F.lit(float(found.count()))
    known = both.join(entities, "entity").join(terms, "term")
    shared = F.log(total * F.col("n_both") / (F.col("n_entity") * F.col("n_term"))) / F.greatest(-F.log(F.col("n_both") / total), F.lit(1e-9))
    telling = known.filter((shared >= disclosure) & (F.col("n_both") >= share * F.col("n_term"))).select("entity", "term")
    of_text = held.join(telling, "entity").groupBy("row").agg(F.collect_set("term").alias("telling"))
    spans = texts.join(of_text, "row").mapInArrow(term_places, "row long, places array<struct<start:long,end:long>>").filter(F.size("places") > 0)
    out = found.drop("text", "entities").withColumn("__row", F.col("__key.row")).join(spans.select(F.col("row").alias("__row"), F.col("places").alias("__terms")), "__row", "left")

    part = F.split(F.when(F.col("base") != "", F.col("base")), ",")
    old = F.transform(part, lambda s: F.struct(F.split(s, ":")[1].cast("long").alias("start"), F.array_position(F.lit(list(KINDS)), F.split(s, ":")[0]).alias("k"), s.alias("s")))
    new = F.transform("__terms", lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS)).cast("long").alias("k"), F.concat_ws(":", F.lit("term"), t["start"].cast("string"), t["end"].cast("string")).alias("s")))
    empty = F.array().cast("array<struct<start:long,k:long,s:string>>")
    every = F.array_sort(F.concat(F.coalesce(old, empty), F.coalesce(new, empty)))
    return out.select(
        F.col("__key.id").alias(id_col), "n_email", "n_ip", "n_card", "n_phone", "base_sha256",
        F.when(F.col("__terms").isNull(), F.col("base")).otherwise(F.array_join(F.transform(every, lambda x: x["s"]), ",")).alias("spans"),
        F.coalesce(F.size("__terms"), F.lit(0)).cast("long").alias("n_term"),
    )


def sanitise(text: str, spans: str) -> str:
    """The text with each span generalised to its kind; disclosing terms are removed. Of overlapping spans the first by start counts."""
    out, last = [], 0
    for span in spans.split(",") if spans else ():
        kind, s, e = span.split(":")
        if int(s) >= last:
            out += [text[last : int(s)], "" if kind == "term" else f"<{kind}>"]
            last = int(e)
    return "".join([*out, text[last:]])


def sanitised(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with their spans generalised or removed. Ids must be unique here, as spans come back by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [t if t is None else sanitise(t, s or "") for t, s in zip(batch.column("__text").to_pylist(), batch.column("__spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["__id", "__new"])

    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    spans = found.select(F.col(id_col).alias("__id"), F.col("spans").alias("__spans"))
    new = rows.join(spans, "__id", "left").mapInArrow(run, f"__id {docs.schema[id_col].dataType.simpleString()}, __new string")
    return docs.join(new, docs[id_col] == new["__id"], "left").withColumn(text_col, F.col("__new")).select(*docs.columns)
