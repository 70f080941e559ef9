"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A letter trigram is the product of its letters' vectors, the first
rotated by two places and the second by one; a text is the sum of its trigrams, and a language the sum of its texts.
A text has the language whose prototype is nearest by cosine.

Defined cases: a null text, or one without a letter, is "und" with score 0; without any labelled row every text is
"und"; ties go to the first language by name; rows whose id or language is null are handled like others (a null
language teaches nothing; a null id counts as the text "null"); repeated rows are documents of their own; texts of any
length are worked on whole (sums are exact up to 16 million letters, and rounded beyond); an empty table gives no rows;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm.common import documents, giving_back, map_text, text_runs

SIZE, SEED = 1024, 11
#: Symbols: none, the letters a to z, then all other letters by their code point.
CLASSES = 64
#: Texts (256 at most, as a byte tells them apart), and different trigrams, that are bundled in one matrix product; texts whose
#: symbols are read at once.
ROWS, GRAMS, FEW = 256, 512, 32
UNDETERMINED = "und"


def _table() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            p = ord(low) if len(low) == 1 else c
            table[c] = p - 96 if 97 <= p <= 122 else 27 + p % (CLASSES - 27)
    return table


class Space:
    """The vectors; built once in each worker."""

    made: Space | None = None

    def __init__(self):
        rng = np.random.default_rng(SEED)
        letters = rng.choice(np.array([-1, 1], np.float32), (CLASSES, SIZE))
        self.first, self.second, self.third = np.roll(letters, 2, 1), np.roll(letters, 1, 1), letters
        self.table = _table()

    @classmethod
    def get(cls) -> Space:
        cls.made = cls.made or cls()
        return cls.made

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        made = self.first[codes >> 12]
        made *= self.second[(codes >> 6) & 63]
        made *= self.third[codes & 63]
        return made

    def grams(self, texts: list[str], at: int) -> np.ndarray:
        """The trigrams of up to ROWS texts, each with its text's place (from `at`) in the lowest byte."""
        symbols = self.table[np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), "<u4")]
        size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        size[0] += 1
        owner = np.repeat(np.arange(at, at + len(texts), dtype=np.uint8), size)  # of each symbol: the text it stands in or ends
        keep = (symbols > 0) | np.r_[True, (symbols[1:] > 0) | (symbols[:-1] > 0) | (owner[1:] != owner[:-1])]
        symbols, owner = symbols[keep], owner[keep]
        real = np.flatnonzero(symbols[1:-1])  # the middle is a letter
        made = owner[1:-1][real].astype(np.int32)
        for k, shift in enumerate((20, 14, 8)):
            made |= symbols[k : len(symbols) - 2 + k][real].astype(np.int32) << shift
        return made

    def bundles(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A vector for each text, and whether it has a letter."""
        out, letters = np.zeros((len(texts), SIZE), np.float32), np.zeros(len(texts), np.bool_)
        for at in range(0, len(texts), ROWS):
            part = texts[at : at + ROWS]
            found = np.concatenate([self.grams(part[a : a + FEW], a) for a in range(0, len(part), FEW)])
            if not len(found):
                continue
            found.sort()
            edge = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])  # of each trigram of each text
            times, found = np.diff(edge, append=len(found)), found[edge]
            codes, of = found >> 8, found & 255
            letters[at + of] = True
            new = np.r_[True, codes[1:] != codes[:-1]]
            known, where = codes[new], np.cumsum(new) - 1
            for first in range(0, len(known), GRAMS):  # so many different trigrams at once
                some = known[first : first + GRAMS]
                a, b = np.searchsorted(where, [first, first + GRAMS])
                counts = np.zeros((len(part), len(some)), np.float32)
                counts[of[a:b], where[a:b] - first] = times[a:b]
                out[at : at + len(part)] += counts @ self.vectors(some)
        return out, letters


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))) % 5 == 0


def prototypes(df: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, list[int]]:
    """Of each language, the sum of its texts' vectors; one partial sum a language leaves each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for first, end in text_runs(batch.column(0)):
                texts, langs = (batch.column(i).slice(first, end - first).to_pylist() for i in range(2))
                for at in range(0, len(texts), ROWS):
                    vectors, _ = Space.get().bundles(texts[at : at + ROWS])
                    for name in set(langs[at : at + ROWS]):
                        rows = [k for k, x in enumerate(langs[at : at + ROWS]) if x == name]
                        sums[name] = sums.get(name, 0) + vectors[rows].astype(np.int64).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "v"])

    known = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(df[text].cast("string"), df[lang].cast("string"))
    parts = known.mapInArrow(giving_back(run), "lang string, v array<long>").select("lang", F.posexplode("v").alias("i", "x"))
    summed = parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    return {r.lang: [x.x for x in r.v] for r in summed.collect() if any(x.x for x in r.v)}


def identify(df: DataFrame, known: dict[str, list[int]], keep=("doc_id",), text: str = "text") -> DataFrame:
    """`keep`, lang_pred and score (0 to 1)."""
    names = sorted(known)
    matrix = np.array([known[n] for n in names], np.float64).reshape(len(names), SIZE)
    matrix /= np.maximum(1e-12, np.linalg.norm(matrix, axis=1, keepdims=True))

    def fn(texts):
        preds, scores = [], []
        for at in range(0, len(texts), ROWS):  # a vector takes more than a short text
            vectors, letters = Space.get().bundles([t or "" for t in texts[at : at + ROWS]])
            if not names:
                letters[:] = False
                near = np.zeros((len(vectors), 1))
            else:
                vectors = vectors.astype(np.float64)
                near = vectors @ matrix.T / np.maximum(1e-12, np.linalg.norm(vectors, axis=1))[:, None]
            best = near.argmax(1)
            preds += [names[b] if ok else UNDETERMINED for b, ok in zip(best, letters, strict=True)]
            scores += np.where(letters, np.clip(near[np.arange(len(near)), best], 0, 1), 0.0).tolist()
        return [preds, scores]

    return map_text(df, keep, text, "lang_pred string, score double", fn)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    made = identify(docs, prototypes(docs.where(~held_out("doc_id"))))
    return made.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
