"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public byte-level vocabulary. The probability of a
word (white-space delimited, A-Z lower-cased, with a leading space) is the sum over all its segmentations into
pieces, by a forward algorithm; that of a text is the product over its words. Piece probabilities are learned by
expectation-maximisation: expected piece counts over all segmentations, from a bounded sample of labelled rows.

The forward algorithm runs over many distinct words at once: position by position, for each piece length, the
piece is found by the hash of its bytes. Words that a worker has scored stay in a bounded cache. Words and pieces of
any length are summed over: a long word is cut only where no piece crosses, which leaves the sum as it is, and what
stays long is summed with logarithms.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.llm import bytekit as bk
from strandweave.llm.quality import held_out

#: Words of at most this many bytes, their leading space included, are summed in plain numbers, raised by LIFT a byte.
SHORT = 64
#: Spans of at most this many bytes are summed many at a time.
BATCHED = 256
#: Languages whose probabilities are held as one matrix.
GROUP = 64
CACHE_WORDS = 1 << 19
LIFT = 4096.0
#: Words that the posterior counts at most.
EVIDENCE = 20
_LETTER = regex.compile(r"\p{L}")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> list[bytes]:
    """Distinct pieces, A-Z lower-cased, in order of their bytes; single bytes are pieces, so every word has a segmentation."""
    with open(path, "rb") as f:
        found = {base64.b64decode(line.split()[0]).lower() for line in f if line.strip()}
    return sorted({p for p in found if p} | {bytes([b]) for b in range(256)})


class Lattice:
    """Finds the pieces of a vocabulary at every position of padded words."""

    def __init__(self, vocabulary: list[bytes]):
        self.size = len(vocabulary)
        data = np.frombuffer(b"".join(vocabulary), np.uint8)
        lens = np.array([len(p) for p in vocabulary])
        self.lengths = np.unique(lens).tolist()
        ends = lens.cumsum()
        h = bk.hashes(data, ends - lens, ends, lower=False)
        order = np.argsort(h)
        self.keys, self.piece = h[order], order
        bits = 20
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64))
        self.probes = int(np.diff(self.first).max())

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of the piece with this hash, or the number of pieces."""
        at = self.first[h >> self.shift]
        out = np.full(len(h), self.size)
        for k in range(self.probes):
            i = np.minimum(at + k, self.size - 1)
            hit = self.keys[i] == h
            out[hit] = self.piece[i[hit]]
        return out

    def _at(self, acc: np.ndarray, live: np.ndarray, e: int, k: int, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of live that have a piece of k bytes ending at e, and the piece."""
        p = self.find(bk.mix((acc[live, e] - acc[live, e - k]) * inverse[e - k] + np.uint64(k * bk._P % (1 << 64))))
        some = np.flatnonzero(p < self.size)
        return live[some], p[some]

    def forward(self, words: np.ndarray, length: np.ndarray, prob: np.ndarray, keep: bool = True) -> tuple[np.ndarray, dict]:
        """alpha (positions x words x languages), raised by LIFT for each byte, and if kept, pieces found by (end, length).

        words: lower-case bytes padded to a common width of at most SHORT; prob: (pieces + 1) x languages, the last row
        0. With the lift, alpha stays within the range of doubles.
        """
        n, width = words.shape
        acc, inverse = _prefix_sums(words)
        alpha = np.zeros((width + 1, n, prob.shape[1]))
        alpha[0] = 1
        found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for e in range(1, width + 1):
            live = np.flatnonzero(length >= e)
            for k in self.lengths:
                if k > e:
                    break
                w, p = self._at(acc, live, e, k, inverse)
                if len(w):
                    if keep:
                        found[e, k] = w, p
                    alpha[e, w] += alpha[e - k, w] * (prob[p] * LIFT**k)
        return alpha, found

    def forward_logs(self, words: np.ndarray, length: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """Log probability (words x languages) of padded words of any width; logs: pieces x languages."""
        n, width = words.shape
        acc, inverse = _prefix_sums(words)
        alpha = np.full((width + 1, n, logs.shape[1]), -np.inf)
        alpha[0] = 0
        for e in range(1, width + 1):
            live = np.flatnonzero(length >= e)
            for k in self.lengths:
                if k > e:
                    break
                w, p = self._at(acc, live, e, k, inverse)
                if len(w):
                    alpha[e, w] = np.logaddexp(alpha[e, w], alpha[e - k, w] + logs[p])
        return alpha[length, np.arange(n)]

    def matches(self, run: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(length, starts, pieces) of all pieces in a run of lower-case bytes."""
        acc, inverse = _prefix_sums(run[None])
        acc, n, out = acc[0], len(run), []
        for k in self.lengths:
            if k > n:
                break
            p = self.find(bk.mix((acc[k:] - acc[:-k]) * inverse[: n - k + 1] + np.uint64(k * bk._P % (1 << 64))))
            at = np.flatnonzero(p < self.size)
            if len(at):
                out.append((k, at, p[at]))
        return out

    def spans(self, run: np.ndarray) -> list[tuple[int, int]]:
        """The run cut at every place that no piece crosses: all its segmentations are those of the spans, combined."""
        cross = np.zeros(len(run) + 1, np.int64)
        for k, at, _ in self.matches(run):
            np.add.at(cross, at + 1, 1)
            np.add.at(cross, at + k, -1)
        cuts = np.flatnonzero(cross.cumsum()[:-1] == 0)
        cuts = np.unique(np.concatenate([[0], cuts[cuts > 0], [len(run)]])).tolist()
        return list(zip(cuts[:-1], cuts[1:], strict=True))

    def by_end(self, span: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each end from 1: lengths and pieces of what ends there."""
        found = self.matches(span)
        ends = np.concatenate([at + k for k, at, _ in found])
        lens = np.concatenate([np.full(len(at), k) for k, at, _ in found])
        which = np.concatenate([p for _, _, p in found])
        order = np.argsort(ends, kind="stable")
        cut = np.searchsorted(ends[order], np.arange(1, len(span) + 2))
        return [(lens[order[a:b]], which[order[a:b]]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _prefix_sums(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, width = words.shape
    power, inverse = bk._powers(width + 1)
    acc = np.zeros((n, width + 1), np.uint64)
    np.cumsum((words.astype(np.uint64) + np.uint64(1)) * power[:width], axis=1, out=acc[:, 1:])
    return acc, inverse


def _pad(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lead: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Words as padded rows, lower-cased, with a leading space if asked for, and their lengths."""
    length = ends - starts
    width = int(length.max())
    at = np.minimum(starts[:, None] + np.arange(width), len(data) - 1)
    out = np.where(np.arange(width) < length[:, None], bk.LOWER[data[at]], 0).astype(np.uint8)
    return (np.pad(out, ((0, 0), (1, 0)), constant_values=32), length + 1) if lead else (out, length)


def _sum_logs(x: np.ndarray) -> np.ndarray:
    top = x.max(0)
    return top + np.log(np.exp(x - top).sum(0))


def _one_long(lattice: Lattice, span: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Log alpha (positions x languages) of one span of any length."""
    alpha = np.full((len(span) + 1, logs.shape[1]), -np.inf)
    alpha[0] = 0
    for e, (k, p) in enumerate(lattice.by_end(span), 1):
        alpha[e] = _sum_logs(alpha[e - k] + logs[p])
    return alpha


def long_word_logs(lattice: Lattice, run: np.ndarray, prob: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Log probability by language of one run of lower-case bytes of any length."""
    spans = np.array(lattice.spans(run))
    size = spans[:, 1] - spans[:, 0]
    total = np.zeros(prob.shape[1])
    order = np.argsort(size, kind="stable")
    for low, high, most in ((0, SHORT, 1 << 18), (SHORT, BATCHED, 1 << 18)):
        group = order[(size[order] > low) & (size[order] <= high)]
        step = max(1, most // high)
        for i in range(0, len(group), step):
            words, length = _pad(run, spans[group[i : i + step], 0], spans[group[i : i + step], 1], lead=False)
            if high == SHORT:
                alpha, _ = lattice.forward(words, length, prob, keep=False)
                total += (np.log(np.maximum(alpha[length, np.arange(len(length))], 1e-300)) - length[:, None] * np.log(LIFT)).sum(0)
            else:
                total += lattice.forward_logs(words, length, logs).sum(0)
    for a, b in spans[size > BATCHED].tolist():
        total += _one_long(lattice, run[a:b], logs)[-1]
    return total


class Model:
    """Languages and their piece probabilities: of each language the pieces that it uses, and what all others get."""

    def __init__(self, languages: list[str], vocabulary: str, columns: list[tuple[np.ndarray, np.ndarray, float]]):
        self.languages, self.vocabulary, self.columns = languages, vocabulary, columns

    def __getstate__(self):
        return {"languages": self.languages, "vocabulary": self.vocabulary, "columns": self.columns}

    def __setstate__(self, state):
        self.__dict__.update(state)

    def _ready(self) -> None:
        if not hasattr(self, "_lattice"):
            self._lattice = Lattice(pieces(self.vocabulary))
            self._keys = np.zeros(0, np.uint64)
            self._logs = np.zeros((0, len(self.languages)), np.float64)
            self._held: tuple[int, np.ndarray, np.ndarray] | None = None

    def _group(self, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities (pieces + 1, the last 0) and their logarithms of at most GROUP languages."""
        if self._held is None or self._held[0] != first:
            some = self.columns[first : first + GROUP]
            prob = np.empty((self._lattice.size + 1, len(some)))
            for j, (at, p, other) in enumerate(some):
                prob[:, j] = other
                prob[at, j] = p
            logs = np.log(prob[:-1])
            prob[-1] = 0
            self._held = first, prob, logs
        return self._held[1:]

    def _word_logs(self, data, starts, ends, h) -> np.ndarray:
        """Log probability by language of each of these distinct words."""
        self._ready()
        at = np.minimum(np.searchsorted(self._keys, h), max(0, len(self._keys) - 1))
        known = self._keys[at] == h if len(self._keys) else np.zeros(len(h), bool)
        out = np.empty((len(h), len(self.languages)))
        out[known] = self._logs[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            order = new[np.argsort(ends[new] - starts[new], kind="stable")]
            short = order[ends[order] - starts[order] < SHORT]
            long = order[len(short) :]
            for first in range(0, len(self.languages), GROUP):
                prob, logs = self._group(first)
                own = slice(first, first + prob.shape[1])
                for i in range(0, len(short), 2048):
                    part = short[i : i + 2048]
                    words, length = _pad(data, starts[part], ends[part])
                    alpha, _ = self._lattice.forward(words, length, prob, keep=False)
                    out[part, own] = np.log(np.maximum(alpha[length, np.arange(len(part))], 1e-300)) - length[:, None] * np.log(LIFT)
                for w in long.tolist():
                    run = np.concatenate([[np.uint8(32)], bk.LOWER[data[starts[w] : ends[w]]]])
                    out[w, own] = long_word_logs(self._lattice, run, prob, logs)
            if len(self._keys) + len(new) > CACHE_WORDS:
                self._keys, self._logs = self._keys[:0], self._logs[:0]
            if len(new) * len(self.languages) <= CACHE_WORDS * 8:
                keys = np.concatenate([self._keys, h[new]])
                order = np.argsort(keys, kind="stable")
                self._keys, self._logs = keys[order], np.concatenate([self._logs, out[new]])[order]
        return out

    def logs(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each whole text by language, and its number of words."""
        data, offs = bk.buffers(col)
        total, n_words = np.zeros((len(offs) - 1, len(self.languages))), np.zeros(len(offs) - 1, np.int64)
        for i, j in bk.blocks(offs):
            a = offs[i]
            seg = data[a : offs[j]]
            starts, ends, row = bk.spans(seg, offs[i : j + 1] - a, bk.NOT_SPACE)
            if not len(starts):
                continue
            h = bk.hashes(seg, starts, ends)
            uniq, first, back = np.unique(h, return_index=True, return_inverse=True)
            logs = self._word_logs(seg, starts[first], ends[first], uniq)[back]
            n_words[i:j] = np.bincount(row, minlength=j - i)
            for k in range(total.shape[1]):
                total[i:j, k] = np.bincount(row, logs[:, k], j - i)
        return total, n_words

    def predict(self, col: pa.Array, evidence: int = EVIDENCE) -> tuple[list[str], np.ndarray]:
        """Language and its posterior; `und` and 0 for a text without a letter or a model without languages.

        The language is the likeliest of the whole text. For the posterior the words of a text count as at most
        `evidence` words of their mean log probability: they aren't independent, and a product over hundreds would make
        every posterior 1. So a text of two languages in equal parts scores near 0.5.
        """
        texts = col.to_pylist()
        letter = np.array([bool(t) and bool(_LETTER.search(t)) for t in texts], bool)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        logs, n_words = self.logs(col)
        best = logs.argmax(1)
        logs = logs * np.minimum(1.0, evidence / np.maximum(n_words, 1))[:, None]
        post = np.exp(logs - logs.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        names = [self.languages[b] if ok else "und" for b, ok in zip(best.tolist(), letter.tolist(), strict=True)]
        return names, np.where(letter, post[np.arange(len(texts)), best], 0.0) if len(texts) else np.zeros(0)


def _sampled(rows: DataFrame, max_rows: int, least: int) -> list[tuple[str, str]]:
    """(lang, text) of about max_rows ids spread over languages, at least `least` of each that has them, lowest hashes first."""
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).collect()  # a row per language
    if not sizes:
        return []
    each = max(least, max_rows // len(sizes))
    share = rows.sparkSession.createDataFrame([(r["lang"], min(1.0, 1.5 * each / max(1, r["n"]))) for r in sizes], "lang string, _share double")
    some = rows.select("lang", "doc_id", "text").join(F.broadcast(share), "lang")
    some = some.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("_share") * (1 << 30))
    some = some.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))  # an id counts once
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id"))
    some = some.withColumn("_r", rank).where(F.col("_r") <= each)
    return [(r["lang"], r["text"]) for r in some.orderBy("lang", "_r").toLocalIterator()]


def fit_language(docs: DataFrame, max_rows: int = 1200, least: int = 20, rounds: int = 3, smooth: float = 0.05, vocabulary: str | None = None) -> Model:
    """Learns from about max_rows documents, those whose id hashes lowest, spread over languages: max_rows / languages of
    each, but `least` at least.

    Any number of languages is learned. Rows of null text, language or id, and held-out ids, never take part; of rows that
    repeat an id and a language the least text does. Ties between languages go to the first in alphabetical order.
    """
    path = vocabulary or default_vocabulary()
    known = F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()
    rows = docs.where(known).select(F.col("lang").cast("string").alias("lang"), "doc_id", F.col("text").cast("string").alias("text"))
    words: dict[str, dict[bytes, int]] = {}
    for lang, text in _sampled(rows, max_rows, least):
        own = words.setdefault(lang, {})
        for w in text.encode("utf-8", "replace").lower().split():
            own[w] = own.get(w, 0) + 1
    names = sorted(words)
    lattice = Lattice(pieces(path)) if names else None
    return Model(names, path, [_learn(lattice, words[k], rounds, smooth) for k in names])


def _learn(lattice: Lattice, counts: dict[bytes, int], rounds: int, smooth: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Pieces used, their probabilities, and that of any other, from words and how often they come."""
    spans: dict[bytes, float] = {}
    for w, n in counts.items():
        run = b" " + w
        cuts = [(0, len(run))] if len(run) <= SHORT else lattice.spans(np.frombuffer(run, np.uint8))
        for a, b in cuts:
            spans[run[a:b]] = spans.get(run[a:b], 0) + n
    own = sorted(spans, key=lambda w: (len(w), w))
    count = np.array([spans[w] for w in own], float)
    n_short = sum(len(w) <= SHORT for w in own)
    data = np.frombuffer(b"".join(own), np.uint8)
    ends = np.cumsum([len(w) for w in own], dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    prob = np.full((lattice.size + 1, 1), 1 / lattice.size)
    prob[-1] = 0
    for _ in range(rounds):
        got = np.full(lattice.size + 1, smooth)
        for i in range(0, n_short, 8192):
            z = min(n_short, i + 8192)
            w, length = _pad(data, starts[i:z], ends[i:z], lead=False)
            got += _expected(lattice, w, length, prob, count[i:z])
        for i in range(n_short, len(own)):
            _expected_long(lattice, data[starts[i] : ends[i]], np.log(prob[:-1, 0]), count[i], got)
        got[-1] = 0
        prob[:, 0] = got / got.sum()
    other = smooth / got.sum() if rounds else 1 / lattice.size
    at = np.flatnonzero(prob[:-1, 0] > other * (1 + 1e-9))
    return at, prob[at, 0], float(other)


def _expected_long(lattice: Lattice, span: np.ndarray, logs: np.ndarray, count: float, got: np.ndarray) -> None:
    """Adds to got the expected uses of each piece over all segmentations of one long span."""
    alpha = _one_long(lattice, span, logs[:, None])[:, 0]
    beta = np.full(len(span) + 1, -np.inf)
    beta[-1] = 0
    for e, (k, p) in reversed(list(enumerate(lattice.by_end(span), 1))):
        beta[e - k] = np.logaddexp(beta[e - k], beta[e] + logs[p])
        np.add.at(got, p, count * np.exp(alpha[e - k] + logs[p] + beta[e] - alpha[-1]))


def _expected(lattice: Lattice, words: np.ndarray, length: np.ndarray, prob: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of words, weighted by count (one language)."""
    n, width = words.shape
    alpha, found = lattice.forward(words, length, prob)
    alpha, p = alpha[:, :, 0], prob[:, 0]
    beta = np.zeros((width + 1, n))
    beta[length, np.arange(n)] = 1
    for (e, k), (w, q) in sorted(found.items(), reverse=True):
        beta[e - k, w] += beta[e, w] * p[q] * LIFT**k
    z = np.maximum(alpha[length, np.arange(n)], 1e-300)
    out = np.zeros(lattice.size + 1)
    for (e, k), (w, q) in found.items():
        out += np.bincount(q, count[w] * alpha[e - k, w] * beta[e, w] * p[q] * LIFT**k / z[w], lattice.size + 1)
    return out


def language_columns(model: Model, text: str = "text") -> Column:
    """struct(lang_pred, score) of each whole text. The broadcast model keeps what a worker has scored."""
    held = SparkSession.getActiveSession().sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def predict(col: pa.Array) -> pa.Array:
        names, score = held.value.predict(col)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    return predict(F.col(text).cast("string"))


def identify_language(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; null or letterless text is `und` with score 0."""
    model = fit_language(docs, **options)
    return docs.select("doc_id", held_out().alias("held_out"), language_columns(model).alias("_l")).select("doc_id", "held_out", "_l.lang_pred", "_l.score")


def keep_language(docs: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The rows of docs, with all their columns, that have a language with a posterior of at least `least`.

    Null, empty and letterless texts go, and without labelled rows all do; null ids and repeated rows are rows as any.
    """
    model = fit_language(docs, **options)
    name = "_language"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, language_columns(model)).where((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") >= least)).drop(name)
