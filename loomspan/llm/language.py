"""Language identification: script ranges, per-word scores and a Viterbi path with a switching penalty."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import WORD_BYTE, Words, steps, stored

#: First code points of script ranges, and the script there. Ranges that are not listed are "other".
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"),
    (0x0C80, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x1380, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"),
    (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x323B0, "other"),
]
STARTS = np.array([s for s, _ in SCRIPTS])
NAMES = sorted({n for _, n in SCRIPTS})
SCRIPT_OF = np.array([NAMES.index(n) for _, n in SCRIPTS])
GRAM_BITS = 16
CHUNK = 64


def word_scripts(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The script of each word by its first character that is no digit, and whether the word has such a character."""
    beyond = np.flatnonzero(WORD_BYTE[w.buf] & (w.buf >= 58))  # bytes of words that are no digits
    at = np.r_[beyond, len(w.buf)][np.searchsorted(beyond, w.start)]
    lettered = at < w.end
    b = [w.buf[np.minimum(at + k, len(w.buf) - 1)].astype(np.int64) for k in range(4)]
    two, three = ((b[0] & 31) << 6) | (b[1] & 63), ((b[0] & 15) << 12) | ((b[1] & 63) << 6) | (b[2] & 63)
    four = ((b[0] & 7) << 18) | ((b[1] & 63) << 12) | ((b[2] & 63) << 6) | (b[3] & 63)
    cp = np.select([b[0] < 0x80, b[0] < 0xE0, b[0] < 0xF0], [b[0], two, three], four)
    return SCRIPT_OF[np.searchsorted(STARTS, cp, side="right") - 1], lettered


def grams(w: Words, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed byte trigrams, with the byte before and after, of the picked words: (gram, start of each word's run, words with any)."""
    size = (w.end - w.start)[pick]
    run = np.cumsum(size) - size
    where = np.repeat(w.start[pick] - run, size) + np.arange(int(size.sum()))
    inside = WORD_BYTE[w.buf]
    byte = np.where(inside, w.buf, 32).astype(np.uint32)
    before = np.where(where > 0, byte[np.maximum(where - 1, 0)], 32)
    code = before | (byte[where] << np.uint32(8)) | (byte[np.minimum(where + 1, len(byte) - 1)] << np.uint32(16))
    return (code * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS), run, size


@dataclass
class Model:
    """Languages, log scores of known words and of hashed trigrams, and the scripts each language is written in."""

    langs: list[str]
    words: np.ndarray
    word_scores: np.ndarray
    gram_scores: np.ndarray
    scripts: np.ndarray
    clip: float = 6.0

    def scores(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of each word for each language, which words have letters, and which of them the model knows."""
        script, lettered = word_scripts(w)
        out = np.zeros((len(w.hash), len(self.langs)), np.float32)
        at = np.minimum(np.searchsorted(self.words, w.hash), max(len(self.words) - 1, 0))
        known = (self.words[at] == w.hash) & lettered if len(self.words) else np.zeros(len(w.hash), bool)
        out[known] = self.word_scores[at[known]]
        rest = np.flatnonzero(lettered & ~known)
        if len(rest):
            g, run, size = grams(w, rest)
            out[rest] = np.add.reduceat(self.gram_scores[g], run, axis=0) / np.sqrt(size)[:, None]
        out -= out.max(axis=1, keepdims=True)
        np.maximum(out, -self.clip, out=out)
        fits = self.scripts[:, script].T  # word by language
        narrowed = lettered & fits.any(axis=1)
        out[narrowed] = np.where(fits[narrowed], out[narrowed], -4 * self.clip)
        out[~lettered] = 0
        return out, lettered, known


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word when each change of label between neighbours costs ``penalty``.

    ``first`` holds where each text's words begin, and the end. Texts are cut into chunks of ``CHUNK`` words; all chunks
    advance together, for every label they may begin with. A pass along each text's chunks picks the labels at the seams,
    and a second run of all chunks together gives the labels inside. So a text of a million words costs no million steps.
    """
    n_labels = scores.shape[1]
    count = np.diff(first)
    chunks = -(-count // CHUNK)
    total = int(chunks.sum())
    labels = np.zeros(len(scores), np.int16)
    if not total or n_labels == 1:
        return labels
    chunk_first = np.r_[0, np.cumsum(chunks)]
    text = np.repeat(np.arange(len(count)), chunks)
    nth = np.arange(total) - chunk_first[text]
    begin = first[text] + nth * CHUNK
    size = np.minimum(CHUNK, first[text + 1] - begin)
    steps_ = np.minimum(begin[:, None] + np.arange(CHUNK), len(scores) - 1)
    x = scores[steps_]
    live = np.arange(CHUNK) < size[:, None]
    a = np.full((total, n_labels, n_labels), -1e9, np.float32)
    a[:, range(n_labels), range(n_labels)] = 0
    for t in range(CHUNK):
        moved = np.maximum(a, a.max(axis=2, keepdims=True) - penalty) + x[:, t, None, :]
        a = np.where(live[:, t, None, None], moved, a)
    seam = np.zeros((total, n_labels), np.float32)
    v = np.zeros((len(count), n_labels), np.float32)
    for k in range(int(chunks.max())):
        who = np.flatnonzero(chunks > k)
        c = chunk_first[who] + k
        seam[c] = v[who]
        v[who] = (v[who][:, :, None] + a[c]).max(axis=1)
        v[who] -= v[who].max(axis=1, keepdims=True)
    end_at, start_at = np.zeros(total, np.int64), np.zeros(total, np.int64)
    state = v.argmax(axis=1)
    for k in range(int(chunks.max()) - 1, -1, -1):
        who = np.flatnonzero(chunks > k)
        c = chunk_first[who] + k
        end_at[c] = state[who]
        start_at[c] = state[who] = (seam[c] + a[c, :, state[who]]).argmax(axis=1)
    every = np.arange(total)
    b = np.full((total, n_labels), -1e9, np.float32)
    b[every, start_at] = 0
    stay = np.ones((CHUNK, total, n_labels), bool)
    best = np.zeros((CHUNK, total), np.int64)
    for t in range(CHUNK):
        best[t] = b.argmax(axis=1)
        top = b[every, best[t]][:, None] - penalty
        stay[t] = (b >= top) | ~live[:, t, None]
        b = np.where(live[:, t, None], np.maximum(b, top) + x[:, t], b)
    cur = end_at.copy()
    for t in range(CHUNK - 1, -1, -1):
        ok = live[:, t]
        labels[steps_[ok, t]] = cur[ok]
        cur = np.where(stay[t, every, cur], cur, best[t])
    return labels


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, feature, count) of labelled texts; kinds: 0 words, 1 trigrams, 2 scripts."""
    total: dict[tuple[str, int], dict[int, int]] = {}
    for batch, texts in steps(batches, "text"):
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        w = Words(texts)
        script, lettered = word_scripts(w)
        of = langs[w.doc]
        for lang in set(langs):
            pick = np.flatnonzero(lettered & (of == lang))
            if not len(pick):
                continue
            for kind, values in enumerate((w.hash[pick].view(np.int64), grams(w, pick)[0].astype(np.int64), script[pick])):
                into = total.setdefault((lang, kind), {})
                for v, c in zip(*(x.tolist() for x in np.unique(values, return_counts=True)), strict=True):
                    into[v] = into.get(v, 0) + c
    for (lang, kind), counts in total.items():
        yield pa.RecordBatch.from_pydict({"lang": [lang] * len(counts), "kind": [kind] * len(counts), "feature": list(counts), "n": list(counts.values())}, pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("feature", pa.int64()), ("n", pa.int64())]))


def fit(docs: DataFrame, per_lang: int = 2000, max_words: int = 10_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit a model on about ``per_lang`` labelled documents of each language, chosen by a hash of the id.

    Word and trigram counts are made and summed on the executors. The driver gets the counts of the ``max_words`` most
    frequent words of each language's sample, of 2**16 trigram cells and of the scripts, for each language. Documents with a
    null id are in the sample or not as their hash says, like all others.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")).alias("key"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").count().collect()  # a row for each language
    langs = sorted(r.lang for r in sizes)
    if not langs:
        return Model([], np.zeros(0, np.uint64), np.zeros((0, 0)), np.zeros((2**GRAM_BITS, 0)), np.zeros((0, len(NAMES)), bool))
    share = F.create_map(*[x for r in sizes for x in (F.lit(r.lang), F.lit(min(1.0, per_lang / r["count"])))])
    sample = rows.filter(F.pmod("key", F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000).select("text", "lang")
    counts = stored(sample.mapInArrow(count_features, "lang string, kind int, feature long, n long").groupBy("kind", "feature", "lang").agg(F.sum("n").alias("n")))
    often = Window.partitionBy("lang").orderBy(F.desc("n"), "feature")  # over the words of a bounded sample
    totals = counts.filter("kind = 0").withColumn("place", F.row_number().over(often)).filter(F.col("place") <= max_words).select("feature").distinct()
    wide = lambda df: df.groupBy("feature").pivot("lang", langs).agg(F.sum("n")).na.fill(0).toPandas()
    words = wide(counts.filter("kind = 0").join(totals, "feature", "left_semi"))
    gram, script = wide(counts.filter("kind = 1")), wide(counts.filter("kind = 2"))

    def logs(table: np.ndarray, smooth: float) -> np.ndarray:
        c = table.astype(np.float64) + smooth
        return np.log(c / c.sum(axis=0)).astype(np.float32)

    keys = words["feature"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    dense = np.zeros((2**GRAM_BITS, len(langs)))
    dense[gram["feature"].to_numpy()] = gram[langs].to_numpy()
    seen = np.zeros((len(langs), len(NAMES)))
    seen[:, script["feature"].to_numpy()] = script[langs].to_numpy().T
    return Model(langs, keys[order], logs(words[langs].to_numpy(), 0.5)[order], logs(dense, 0.5), seen >= 0.01 * seen.sum(axis=1, keepdims=True))


SCHEMA = "lang_pred string, score double, n_words long, n_known long, n_spans long, spans array<struct<lang:string,first_word:int,n_words:int>>"


def labelled(docs: DataFrame, model: Model, penalty: float, keep: list[str], text_col: str) -> DataFrame:
    """What ``identify`` finds, with the columns ``keep`` under the names __0, __1, ..."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = [f"__{k}" for k in range(len(keep))]
    text_at = f"__{keep.index(text_col)}" if text_col in keep else "__text"  # the text is sent once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        span = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())]))
        for batch, texts in steps(batches, text_at, 800_000 // max(1, len(m.langs) ** 2 // 16)):
            n, k = len(texts), len(m.langs)
            pred, score, words, known, spans = ["und"] * n, [0.0] * n, [0] * n, [0] * n, [[] for _ in range(n)]
            if k:
                w = Words(texts)
                s, lettered, in_model = m.scores(w)
                label = viterbi(s, w.first, penalty)
                known = np.bincount(w.doc[in_model], minlength=n).tolist()
                votes = np.bincount((w.doc * k + label)[lettered], minlength=n * k).reshape(n, k)
                cut = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (w.doc[1:] != w.doc[:-1])]) if len(label) else np.zeros(0, int)
                for at, end in zip(cut.tolist(), [*cut[1:].tolist(), len(label)], strict=True) if len(cut) else ():
                    d = int(w.doc[at])
                    spans[d].append({"lang": m.langs[label[at]], "first_word": at - int(w.first[d]), "n_words": end - at})
                for d, (v, t) in enumerate(zip(votes.tolist(), votes.sum(axis=1).tolist(), strict=True)):
                    if t and any(map(str.isalpha, texts[d])):  # beyond ASCII, a word may be made of other signs
                        words[d] = t
                        pred[d], score[d] = m.langs[max(range(k), key=v.__getitem__)], max(v) / t
                    else:
                        spans[d] = []
            cols = [batch.column(c) for c in held] + [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(words, pa.int64()), pa.array(known, pa.int64()), pa.array(map(len, spans), pa.int64()), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays(cols, [*held, "lang_pred", "score", "n_words", "n_known", "n_spans", "spans"])

    schema = "".join(f"{h} {docs.schema[c].dataType.simpleString()}, " for h, c in zip(held, keep, strict=True)) + SCHEMA
    return docs.select(*[F.col(c).alias(h) for h, c in zip(held, keep, strict=True)], *([F.col(text_col).alias(text_at)] if text_at == "__text" else [])).mapInArrow(run, schema)


def identify(docs: DataFrame, model: Model, penalty: float = 10.0, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The language of each text, and its spans by language.

    Each word is scored for each language that is written in the word's script (for all, if none is); unknown words by their
    trigrams. A Viterbi path over the words, with ``penalty`` for each change, labels spans. ``lang_pred`` has most of the
    lettered words; ``score`` is its share of them, 0 to 1; ties go to the first language by name. Texts that are null, empty or without a
    letter, and any text where nothing was learned, give ``und``, score 0 and no span. The columns ``keep`` pass
    through; one named like a result gives way to it.
    """
    found = labelled(docs, model, penalty, list(keep), text_col)
    names = [c for c in found.columns if not c.startswith("__")]
    return found.select(*[F.col(f"__{k}").alias(c) for k, c in enumerate(keep) if c not in names], *names)


def spoken(docs: DataFrame, model: Model, min_known: float = 0.1, min_words: int = 20, penalty: float = 10.0, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, whose text has letters and fits the languages learned.

    A text of ``min_words`` words or more fits if the model knows at least ``min_known`` of them, in whatever language each is: texts of
    several languages stay, those of a language never learned go. A shorter text with letters stays.
    """
    found = labelled(docs, model, penalty, docs.columns, text_col)
    fits = (F.col("n_words") < min_words) | (F.col("n_known") >= F.lit(min_known) * F.col("n_words"))
    return found.filter((F.col("lang_pred") != "und") & fits).select(*[F.col(f"__{k}").alias(c) for k, c in enumerate(docs.columns)])


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from training: crc32 of the id as text is a multiple of 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
