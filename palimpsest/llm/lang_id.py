"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to order three, counted once on a
bounded sample and frozen. A byte costs the code length of its symbol in the
longest context of the tree that ends there; a context that has not seen the
symbol charges its escape probability (method C: distinct symbols over all
symbols plus distinct ones) and hands over to the next shorter context, down to
a uniform byte. Contexts never seen in a language cost nothing to leave. Trees
hold all contexts and byte values of the sample, of every language it has. The
language of least code length wins.

A tree is kept as sorted codes of the four bytes a symbol and its contexts are.
Of a stretch of text each distinct run of four bytes is looked up once in each
tree; a text's exact code length is the sum over its bytes. A language's tree
is fitted in a task of its own, so the driver holds the finished trees alone.

A language also has a limit of code length a byte, from its own sample: rows are
coded by a tree fitted on the other half of the rows, and the limit lies MARGIN
above what the costliest of them took. A text that takes more in the language
found for it is ``foreign``: it isn't of a learned language.

Letters A-Z are taken as lower case. Texts that are null or hold no letter are
``und`` with score 0 and no code length, and not foreign. Ties go to the first
language in alphabetical order. Null labels teach nothing; repeated rows count
each. A label whose rows are all longer than the sample's bound is learned from
their beginnings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import kernels
from palimpsest.llm.spark_io import bounded_sample, doc_bucket, with_fields

ORDER = 3
#: What precedes a text: a byte that lower-cased texts don't hold.
START = 65
#: Bounds of the sample a model is fitted on: rows of each language, and code points of a row.
SAMPLE_ROWS = 300
SAMPLE_LENGTH = 10_000
#: Bits a byte that a text may take beyond the costliest held-out row of its language, and bits any text may take beyond that.
MARGIN, SLACK = 0.25, 48.0
#: Bytes a row must have to count for its language's limit.
LIMIT_BYTES = 200


@dataclass
class Tree:
    """The frozen statistics of a language, by order: runs of context and symbol, contexts, and code lengths in nats."""

    runs: list[np.ndarray]
    costs: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]
    limit: float = np.inf

    def code_lengths(self, codes: np.ndarray) -> np.ndarray:
        """Of the last byte of each run of four."""
        out = np.zeros(len(codes), dtype=np.float32)
        left = np.arange(len(codes))
        for order in range(ORDER, -1, -1):
            run = codes[left] & np.uint32((1 << 8 * (order + 1)) - 1)
            at, hit = _find(self.runs[order], run)
            out[left[hit]] += self.costs[order][at[hit]]
            left, run = left[~hit], run[~hit]
            at, known = _find(self.contexts[order], run >> np.uint32(8))
            out[left[known]] += self.escapes[order][at[known]]
        out[left] += np.float32(np.log(256))
        return out

    def packed(self) -> list[bytes]:
        return [np.float64(self.limit).tobytes(), *(a.tobytes() for kind in (self.runs, self.costs, self.contexts, self.escapes) for a in kind)]

    @staticmethod
    def unpacked(parts: list[bytes]) -> Tree:
        kinds = ("<u4", "<f4", "<u4", "<f4")
        arrays = [[np.frombuffer(p, dtype=kind) for p in parts[1 + k * (ORDER + 1) :][: ORDER + 1]] for k, kind in enumerate(kinds)]
        return Tree(*arrays, float(np.frombuffer(parts[0], dtype=np.float64)[0]))


def _find(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted values among sorted ones, and whether they are there."""
    if not len(known):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


def _codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte with the three before it in its text, the nearest in the lowest place but one."""
    symbols = kernels._LOWER[data]
    code = symbols.astype(np.uint32)
    since = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for back in range(1, ORDER + 1):
        before = np.full(len(data), START, dtype=np.uint32)
        before[back:] = symbols[:-back]
        before[since < back] = START
        code |= before << np.uint32(8 * back)
    return code


def grow(texts: list[bytes]) -> Tree:
    """The tree of sample texts. A context that begins before its text isn't one."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    code = _codes(data, offsets)
    since = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    tree = Tree([], [], [], [])
    for order in range(ORDER + 1):
        runs, n = np.unique(code[since >= order] & np.uint32((1 << 8 * (order + 1)) - 1), return_counts=True)
        contexts, at, distinct = np.unique(runs >> np.uint32(8), return_inverse=True, return_counts=True)
        all_ = np.bincount(at, weights=n, minlength=len(contexts)) + distinct
        tree.runs.append(runs)
        tree.contexts.append(contexts)
        tree.costs.append(-np.log(n / all_[at]).astype(np.float32))
        tree.escapes.append(-np.log(distinct / all_).astype(np.float32))
    return tree


@dataclass
class LanguageModel:
    languages: list[str]
    trees: list[Tree]

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length in nats of each text in each language."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        if not len(data):
            return out
        codes, at = np.unique(_codes(data, offsets), return_inverse=True)
        full = np.flatnonzero(np.diff(offsets) > 0)
        for k, tree in enumerate(self.trees):
            out[full, k] = np.add.reduceat(tree.code_lengths(codes)[at], offsets[full], dtype=np.float64)
        return out


def fit(samples: dict[str, list[bytes]]) -> LanguageModel:
    """Frozen trees of all languages from sample texts, with their limits."""
    languages = sorted(samples)
    return LanguageModel(languages, [_fit_language(samples[name]) for name in languages])


def _fit_language(texts: list[bytes]) -> Tree:
    tree, worst = grow(texts), []
    for own in (0, 1):
        coded = [t for t in texts[own::2] if len(t) >= LIMIT_BYTES]
        if coded and len(texts) > 1:
            data = np.frombuffer(b"".join(coded), dtype=np.uint8)
            sizes = np.array([len(t) for t in coded])
            bits = LanguageModel([""], [grow(texts[1 - own :: 2])]).lengths(data, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))[:, 0] / np.log(2)
            worst.append((bits / sizes).max())
    tree.limit = max(worst) + MARGIN if worst else np.inf
    return tree


def _fit_group(rows: pa.Table) -> pa.Table:
    texts = [t.encode() for _, t in sorted(zip(rows["id"].to_pylist(), rows["text"].to_pylist()), key=lambda r: (str(r[0]), r[1]))]
    return pa.table({"label": rows["label"][:1], "tree": pa.array([_fit_language(texts).packed()], pa.list_(pa.binary()))})


def fit_on_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", folds: int = 3, held_out: int = 1, rows: int = SAMPLE_ROWS, length: int = SAMPLE_LENGTH) -> LanguageModel | None:
    """A model of labelled rows outside the held-out fold; None if there are none."""
    text = F.col(text_col)
    labelled = docs.select(F.col(id_col).alias("id"), F.substring(text, 1, length).alias("text"), F.col(label_col).alias("label"), (F.length(text) > length).cast("int").alias("late")).where(
        F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}") & F.coalesce(doc_bucket("id", folds) != held_out, F.lit(False))
    )
    sample = bounded_sample(labelled, "label", "id", rows, "late").select("id", "text", "label")
    told = sorted((r.label, r.tree) for r in sample.groupBy("label").applyInArrow(_fit_group, "label string, tree array<binary>").toLocalIterator())
    return LanguageModel([name for name, _ in told], [Tree.unpacked(parts) for _, parts in told]) if told else None


def identify(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (the posterior of the language), bits_per_byte and foreign; columns by these names are replaced."""
    names = ["lang_pred", "score", "bits_per_byte", "foreign"]
    kept = docs.drop(*names, "__letters")
    if model is None:
        return kept.select("*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"), F.lit(False).alias("foreign"))
    ready = kept.withColumn("__letters", F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    at, letters_at, out_names = kept.columns.index(text_col), len(kept.columns), [*kept.columns, *names]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches) -> Iterator[pa.RecordBatch]:
        own = shared.value
        languages, limits = np.array(own.languages, dtype=object), np.array([t.limit for t in own.trees])
        for batch in batches:
            data, offsets = kernels.utf8(batch.column(at))
            lengths = np.zeros((batch.num_rows, len(languages)))
            for lo, hi in kernels.chunks(offsets):
                part = offsets[lo : hi + 1]
                lengths[lo:hi] = _in_pieces(own, data[part[0] : part[-1]], part - part[0])
            letters = np.asarray(batch.column(letters_at).to_numpy(zero_copy_only=False), dtype=bool)
            best = lengths.argmin(1)
            least = lengths[np.arange(len(best)), best]
            score = 1 / np.exp(least[:, None] - lengths).sum(1)
            size, bits = np.maximum(np.diff(offsets), 1), least / np.log(2)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array(np.where(letters, languages[best], "und"), pa.string()),
                    pa.array(np.where(letters, score, 0.0)),
                    pa.array(bits / size, mask=~letters),
                    pa.array(letters & (bits > limits[best] * size + SLACK)),
                ],
                names=out_names,
            )

    return ready.mapInArrow(kernels.tidy(run), with_fields(kept.schema, lang_pred="string", score="double", bits_per_byte="double", foreign="boolean"))


def _in_pieces(model: LanguageModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code lengths; a text longer than a chunk is summed piece by piece, each with the bytes before it."""
    size = kernels.CHUNK_BYTES
    if len(offsets) > 2 or len(data) <= 2 * size:
        return model.lengths(data, offsets)
    total = np.zeros((1, len(model.languages)))
    for a in range(0, len(data), size):
        lead = min(a, ORDER)
        run = data[a - lead : a + size]
        total += model.lengths(run, np.array([0, len(run)]))
        if lead:  # the lead was paid for by the piece before
            total -= model.lengths(run[:lead], np.array([0, lead]))
    return total
