"""Main text of web pages by a recurrent block labeller.

A page is read into its leaf sequence: blocks of text between borders of
block-level elements, each with the path of tags, classes, ids and roles above
it. A block is described by the mean of hashed path vectors, the mean of hashed
word vectors and a few plain measures. A bidirectional LSTM in numpy reads the
whole sequence of a page and labels every block, so a block is judged by what
stands anywhere before and after it.

The labeller is trained on generated pages of many layouts (``layouts``), whose
labels are known; no page of a table is used. Texts keep every block labelled
as main, in page order: character references decoded, white space within a
block turned into one space, blocks joined by a line feed. Null and empty pages
and pages without main blocks give an empty text. Tags cut off at the end of a
page are markup; elements left open are closed by what follows them. Reading is
linear in the page: paths are kept as the sequence of elements opened and closed,
whose running sum of path vectors is a block's, however deep it lies. Repeated
rows are read each for itself; other columns are carried along.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import kernels
from palimpsest.llm.layouts import generate_pages
from palimpsest.llm.spark_io import with_fields

# Names of HTML elements by how they are read.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section select summary table tbody td "
    "textarea tfoot th thead tr ul".split()
)
RAW = frozenset("script style title textarea iframe noembed noframes noscript template xmp svg math object audio video canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the key closes open elements of the values, up to the nearest of the stops.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
STOPS = frozenset("ul ol dl table select body html".split())

TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
WORD = re.compile(r"[a-z]+")

PATH_BITS, WORD_BITS = 10, 11
PLAIN = 6


@dataclass
class Block:
    steps: int  # of the page's steps, those before it
    depth: int  # path tokens above it
    text: str
    linked: int  # signs of it that lie in links


@dataclass
class Leaves:
    """The blocks of a page, and its steps: a path token opened (its slot + 1) or closed (minus that)."""

    blocks: list[Block]
    steps: list[int]


class _Stack:
    """Open elements. What a tag closes is found by name, so no step looks through the whole stack."""

    def __init__(self):
        self.names: list[str] = []
        self.tokens: list[tuple[int, ...]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.steps: list[int] = []
        self.depth = 0

    def last(self, names) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def open(self, name: str, tokens: tuple[int, ...]) -> None:
        if name in BLOCK:
            self.blocks.append(len(self.names))
        self.places.setdefault(name, []).append(len(self.names))
        self.names.append(name)
        self.tokens.append(tokens)
        self.steps += [t + 1 for t in tokens]
        self.depth += len(tokens)

    def cut(self, at: int) -> None:
        """Close all from the place ``at`` on."""
        while len(self.names) > at:
            name, tokens = self.names.pop(), self.tokens.pop()
            self.places[name].pop()
            self.steps += [-t - 1 for t in tokens]
            self.depth -= len(tokens)
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()

    def make_room(self, name: str) -> None:
        """Close what an opening block-level tag ends."""
        if name not in ("button", "label") and self.blocks and self.names[self.blocks[-1]] == "p":
            self.cut(self.blocks[-1])
        if name in CLOSES:
            stop = self.last(STOPS)
            while (at := self.last(CLOSES[name])) > stop:
                self.cut(at)


@lru_cache(20_000)
def _marks(tag: str, attributes: str) -> tuple[int, ...]:
    """Hashed tokens of an element: its tag, and words of its class, id and role."""
    tokens = [tag]
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "style":
            if "none" in value and "display" in value:
                tokens.append("hidden")
        elif name in ("hidden", "aria-hidden"):
            if value != "false":
                tokens.append("hidden")
        else:
            tokens += [f".{w}" for w in WORD.findall(value)]
    return tuple(_slot(t) for t in tokens)


def _slot(token: str) -> int:
    raw = np.frombuffer(token.encode(), dtype=np.uint8)
    return int(kernels.span_hashes(raw, np.array([0]), np.array([len(raw)]))[0] & np.uint64((1 << PATH_BITS) - 1))


def read_blocks(page: str) -> Leaves:
    """The leaf sequence of a page."""
    blocks: list[Block] = []
    stack = _Stack()
    parts: list[str] = []
    linked = 0
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                blocks.append(Block(len(stack.steps), stack.depth, text, min(linked, len(text))))
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html_lib.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if stack.places.get("a"):
                linked += len(text.strip())

    while at < n:
        found = TAG.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        name = found[2] or found[5]
        if not name:
            continue
        name, closing, attributes = name.lower(), found[1] or found[4], found[3] or found[6] or ""
        if closing:
            if name in BLOCK:
                flush()
            if (place := stack.last((name,))) >= 0:
                stack.cut(place)
            continue
        if name in RAW:
            if not attributes.endswith("/"):
                end = re.compile(f"</{re.escape(name)}\\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if name == "br":
            parts.append(" ")
        if name in BLOCK:
            flush()
            stack.make_room(name)
        if name not in VOID and not attributes.endswith("/"):
            stack.open(name, _marks(name, attributes))
    flush()
    stack.cut(0)
    return Leaves(blocks, stack.steps)


@dataclass
class Described:
    """What the labeller reads of all blocks of all pages in a row."""

    slots: np.ndarray  # of the steps of all pages
    signs: np.ndarray
    steps: np.ndarray  # of each block: the steps before it
    depth: np.ndarray
    words: np.ndarray  # slots of words, and where those of each block end
    word_ends: np.ndarray
    plain: np.ndarray


def describe(pages: list[Leaves]) -> Described:
    blocks = [b for page in pages for b in page.blocks]
    steps = np.fromiter((t for page in pages for t in page.steps), dtype=np.int64)
    before = np.cumsum([0, *(len(p.steps) for p in pages)])
    at = np.repeat(before[:-1], [len(p.blocks) for p in pages]) + np.array([b.steps for b in blocks], dtype=np.int64)
    depth = np.array([b.depth for b in blocks], dtype=np.int64)
    texts = [b.text.encode() for b in blocks]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    starts, ends, first = kernels.word_spans(data, offsets)
    words = (kernels.span_hashes(data, starts, ends) & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
    size = np.array([len(b.text) for b in blocks], dtype=np.float64)
    linked = np.array([b.linked for b in blocks], dtype=np.float64)
    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    stops, digits = sums(np.isin(data, [0x2C, 0x2E, 0x21, 0x3F])), sums((data >= 48) & (data < 58))
    n_words = np.diff(first)
    safe = np.maximum(size, 1)
    plain = np.stack([np.log1p(size) / 6, linked / safe, stops / np.maximum(n_words, 1), digits / safe, np.log1p(n_words) / 5, depth / 12], 1)
    return Described(np.abs(steps) - 1, np.sign(steps), at, depth, words, first[1:], plain)


def _means(table: np.ndarray, slots: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros((1, table.shape[1])), np.cumsum(table[slots], axis=0, dtype=np.float64)])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    return (sums[ends] - sums[starts]) / np.maximum(ends - starts, 1)[:, None]


def _path_means(table: np.ndarray, d: Described) -> np.ndarray:
    """The mean vector of the tokens open at each block."""
    sums = np.concatenate([np.zeros((1, table.shape[1])), np.cumsum(table[d.slots] * d.signs[:, None], axis=0, dtype=np.float64)])
    return sums[d.steps] / np.maximum(d.depth, 1)[:, None]


def _path_gradient(shape: tuple[int, int], d: Described, pull: np.ndarray) -> np.ndarray:
    """The gradient of the path table, given that of the means."""
    share = np.zeros((len(d.slots) + 1, shape[1]))
    np.add.at(share, d.steps, pull / np.maximum(d.depth, 1)[:, None])
    after = np.cumsum(share[::-1], axis=0)[::-1][1:]  # a step counts for every block behind it
    out = np.zeros(shape)
    np.add.at(out, d.slots, after * d.signs[:, None])
    return out


@dataclass
class Labeller:
    """A bidirectional LSTM over block vectors; all parameters in one dictionary."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int = 3, path_dim: int = 16, word_dim: int = 8, hidden: int = 24) -> Labeller:
        rng = np.random.default_rng(seed)
        inputs = path_dim + word_dim + PLAIN
        w = {"path": rng.normal(0, 0.3, (1 << PATH_BITS, path_dim)), "word": rng.normal(0, 0.1, (1 << WORD_BITS, word_dim))}
        for d in "fb":
            w[f"{d}_x"] = rng.normal(0, 0.3, (inputs, 4 * hidden))
            w[f"{d}_h"] = rng.normal(0, 0.2, (hidden, 4 * hidden))
            bias = np.zeros(4 * hidden)
            bias[hidden : 2 * hidden] = 1.0  # remember at first
            w[f"{d}_b"] = bias
        w["out"] = rng.normal(0, 0.3, (2 * hidden + inputs, 1))
        w["out_b"] = np.zeros(1)
        return Labeller(w)

    def vectors(self, d: Described) -> np.ndarray:
        return np.concatenate([_path_means(self.weights["path"], d), _means(self.weights["word"], d.words, d.word_ends), d.plain], 1)

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits [time, page] of padded vectors [time, page, input]; with ``keep`` also what training needs."""
        states, trace = [], {}
        for d in "fb":
            steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
            hidden = self.weights[f"{d}_h"].shape[0]
            h, c = np.zeros((x.shape[1], hidden), x.dtype), np.zeros((x.shape[1], hidden), x.dtype)
            pre = x @ self.weights[f"{d}_x"] + self.weights[f"{d}_b"]
            out, kept = np.zeros((*x.shape[:2], hidden), x.dtype), []
            for t in steps:
                z = pre[t] + h @ self.weights[f"{d}_h"]
                gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * hidden], -60, 60)))
                i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
                g = np.tanh(z[:, 3 * hidden :])
                m = mask[t][:, None]
                c_new = f * c + i * g
                tc = np.tanh(c_new)
                if keep:
                    kept.append((t, i, f, o, g, c, tc, h))
                h, c = np.where(m, o * tc, h), np.where(m, c_new, c)
                out[t] = h
            states.append(out)
            trace[d] = kept
        top = np.concatenate([*states, x], 2)
        logits = (top @ self.weights["out"])[..., 0] + self.weights["out_b"][0]
        return (logits, top, trace) if keep else logits

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Gradients of the mean cross-entropy by parameter, and by input vector."""
        logits, top, trace = self.run(x, mask, keep=True)
        p = 1 / (1 + np.exp(-logits))
        n = max(1, mask.sum())
        loss = float(-(np.log(np.where(y > 0, p, 1 - p) + 1e-9) * mask).sum() / n)
        d_logit = (p - y) * mask / n
        grads = {"out": np.einsum("tbi,tb->i", top, d_logit)[:, None], "out_b": np.array([d_logit.sum()])}
        d_top = d_logit[..., None] * self.weights["out"][:, 0]
        hidden = self.weights["f_h"].shape[0]
        dx = d_top[..., 2 * hidden :].copy()
        for k, d in enumerate("fb"):
            d_out = d_top[..., k * hidden : (k + 1) * hidden]
            dh_next, dc_next = np.zeros(d_out.shape[1:]), np.zeros(d_out.shape[1:])
            dz_all = np.zeros((*x.shape[:2], 4 * hidden))
            g_h = np.zeros_like(self.weights[f"{d}_h"])
            for t, i, f, o, g, c, tc, h in reversed(trace[d]):
                m = mask[t][:, None]
                dh = d_out[t] + dh_next
                live, rest = dh * m, dh * ~m
                dc = dc_next * m + live * o * (1 - tc**2)
                dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), live * tc * o * (1 - o), dc * i * (1 - g**2)], 1)
                dz_all[t] = dz
                g_h += h.T @ dz
                dh_next = dz @ self.weights[f"{d}_h"].T + rest
                dc_next = dc * f + dc_next * ~m
            grads[f"{d}_h"] = g_h
            grads[f"{d}_x"] = np.einsum("tbi,tbj->ij", x, dz_all)
            grads[f"{d}_b"] = dz_all.sum((0, 1))
            dx += dz_all @ self.weights[f"{d}_x"].T
        return grads, dx, loss


def _padded(vectors: np.ndarray, counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(counts)
    x = np.zeros((longest, len(counts), vectors.shape[1]), vectors.dtype)
    mask = np.zeros((longest, len(counts)), dtype=bool)
    at = 0
    for j, n in enumerate(counts):
        x[:n, j] = vectors[at : at + n]
        mask[:n, j] = True
        at += n
    return x, mask


@lru_cache(2)
def trained_labeller(pages: int = 2000, epochs: int = 10, batch: int = 24, rate: float = 0.01, seed: int = 5) -> Labeller:
    """A labeller trained on generated pages; the same for the same parameters."""
    rng = np.random.default_rng(seed)
    examples = []
    for page, wanted in generate_pages(pages, seed):
        leaves = read_blocks(page)
        labels = np.array([b.text in wanted for b in leaves.blocks], dtype=np.float64)
        if leaves.blocks:
            examples.append((leaves, labels))
    model = Labeller.fresh()
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.weights.items()}
    step = 0
    for epoch in range(epochs):
        lengths = np.array([len(labels) for _, labels in examples])
        order = np.lexsort((rng.random(len(examples)), lengths // 8))
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        rng.shuffle(groups)
        for rows in groups:
            described = describe([examples[i][0] for i in rows])
            counts = [len(examples[i][1]) for i in rows]
            x, mask = _padded(model.vectors(described), counts)
            y = np.zeros(mask.shape)
            for j, i in enumerate(rows):
                y[: len(examples[i][1]), j] = examples[i][1]
            grads, dx, _ = model.gradients(x, mask, y)
            flat = np.concatenate([dx[:n, j] for j, n in enumerate(counts)])
            at, to = model.weights["path"].shape[1], model.weights["path"].shape[1] + model.weights["word"].shape[1]
            grads["path"] = _path_gradient(model.weights["path"].shape, described, flat[:, :at])
            n = np.diff(np.concatenate([[0], described.word_ends]))
            grads["word"] = np.zeros_like(model.weights["word"])
            np.add.at(grads["word"], described.words, np.repeat(flat[:, at:to] / np.maximum(n, 1)[:, None], n, axis=0))
            step += 1
            pace = rate * (1 - 0.8 * epoch / epochs)
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                model.weights[k] -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.weights = {k: v.astype(np.float32) for k, v in model.weights.items()}
    return model


def label_pages(model: Labeller, pages: list[Leaves], batch: int = 256) -> list[np.ndarray]:
    """For each page, whether each of its blocks is main text."""
    sizes = [len(p.blocks) for p in pages]
    out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(pages)
    order = sorted((i for i in range(len(pages)) if sizes[i]), key=sizes.__getitem__)
    at = 0
    while at < len(order):
        rows = order[at : at + batch]
        if sizes[rows[-1]] > 400:  # long pages are run in smaller batches
            rows = rows[: max(1, batch * 400 // (sizes[rows[-1]] + 1) // 4)]
        at += len(rows)
        vectors = model.vectors(describe([pages[i] for i in rows])).astype(np.float32)
        x, mask = _padded(vectors, [sizes[i] for i in rows])
        logits = model.run(x, mask)
        for j, i in enumerate(rows):
            out[i] = logits[: sizes[i], j] > 0
    return out


def extract_main_text(df: DataFrame, html_col: str = "html", out_col: str = "text", model: Labeller | None = None) -> DataFrame:
    """df without its html, with the main text and ``n_blocks`` read; columns by these names are replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model or trained_labeller())
    kept = df.drop(out_col, "n_blocks") if html_col != out_col else df.drop("n_blocks")
    at = kept.columns.index(html_col)
    others = [i for i in range(len(kept.columns)) if i != at]
    names = [*(kept.columns[i] for i in others), out_col, "n_blocks"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                pages = [read_blocks(p.as_py() or "") for p in batch.column(at)]
                texts = ["\n".join(b.text for b, main in zip(leaves.blocks, labels) if main) for leaves, labels in zip(pages, label_pages(own, pages))]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in others), pa.array(texts, pa.string()), pa.array([len(p.blocks) for p in pages], pa.int64())], names=names
                )

    return kept.mapInArrow(kernels.tidy(run), with_fields(kept.drop(html_col).schema, **{out_col: "string", "n_blocks": "long"}))
