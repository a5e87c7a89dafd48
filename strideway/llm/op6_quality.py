"""Quality rules: base counts of each text, and a labelling of its lines as content or boilerplate.

The lines of a text are the positions of a linear-chain conditional random field with two labels. A line's features are
bins of a few shares (words, symbols, capitals, distinct words, ...); weights for bins, for neighbouring labels and for the
first label are fitted on the lines of a bounded sample of labelled documents, whose quality label every line inherits.
Viterbi decoding labels the lines; a text is kept when enough of its words stand in content lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, rolled, ship, slices, word_hashes

SYMBOLS = b"#*$%&|<>"
#: Bounds of each feature's bins: words, symbols, bars and ! per word, distinct words per word, bytes per word, digits.
BINS = {
    "words": (1, 3, 8, 20, 50),
    "symbols": (0, 0.1, 0.3, 0.7),
    "bars": (0, 0.1, 0.3, 0.7),
    "exclamations": (0, 0.1, 0.3, 0.7),
    "distinct": (0.3, 0.5, 0.7, 0.9),
    "length": (3, 5, 7, 10),
    "digits": (0, 0.05, 0.2),
}
FLAGS = ("capitals", "repeated", "sentence", "address")
N_BINS = sum(len(b) + 1 for b in BINS.values()) + 2 * len(FLAGS)
#: Labelled documents to learn from at most, lines to a training sequence, and such sequences of one document at most.
SAMPLE_DOCS, SEQUENCE, SEQUENCES = 4000, 64, 8
STEPS, RATE, RIDGE = 150, 0.3, 1e-3
CONTENT_SHARE = 0.5
COUNTS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


@dataclass(frozen=True)
class LineField:
    """Weights of label 1 (boilerplate) against label 0 (content): bins, label pairs (before, after), first labels."""

    bins: np.ndarray
    pairs: np.ndarray
    first: np.ndarray


def line_features(lines: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """Numbers of the bins that each line falls in, a row for each line, and the lines' words."""
    rows, words, seen = [], [], set()
    for line in lines:
        own = line.split()
        n = len(own)
        words.append(n)
        per, text = max(n, 1), line.decode()
        rows.append(
            (
                n,
                sum(map(line.count, (b"#", b"*", b"$", b"%", b"&", b"<", b">"))) / per,
                line.count(b"|") / per,
                line.count(b"!") / per,
                len(set(own)) / per,
                len(text) / per,
                sum(map(line.count, (b"0", b"1", b"2", b"3", b"4", b"5", b"6", b"7", b"8", b"9"))) / max(len(line), 1),
                text.isupper(),
                n > 0 and line in seen,
                line.rstrip().endswith((b".", b"!", b"?")),
                b"@" in line or b"://" in line,
            )
        )
        seen.add(line)
    values = np.array(rows, float)
    out, base = np.empty(values.shape, np.int16), 0
    for i, bounds in enumerate(BINS.values()):
        out[:, i] = base + np.searchsorted(bounds, values[:, i], "left")
        base += len(bounds) + 1
    for i in range(len(BINS), values.shape[1]):
        out[:, i] = base + values[:, i]
        base += 2
    return out, words


def train(sequences: list[tuple[np.ndarray, int]]) -> LineField:
    """Maximum likelihood with a ridge, by Adam; sequences: line bins and the label that all their lines have.

    The forward and backward sums go over all sequences at once, position by position.
    """
    cut = [(x[i : i + SEQUENCE], y) for x, y in sequences for i in range(0, len(x), SEQUENCE)]
    cut.sort(key=lambda s: -len(s[0]))
    n = np.array([len(x) for x, _ in cut])
    longest, y = n[0], np.array([y for _, y in cut])
    x = np.zeros((len(cut), longest, cut[0][0].shape[1]), np.int64)
    for row, (own, _) in zip(x, cut, strict=True):
        row[: len(own)] = own
    live = [int((n > t).sum()) for t in range(longest)]  # sequences are in order of length
    weights = np.zeros(N_BINS + 4 + 2)
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, STEPS + 1):
        bins, pairs, first = weights[:N_BINS], weights[N_BINS : N_BINS + 4].reshape(2, 2), weights[N_BINS + 4 :]
        score = np.stack([np.zeros(x.shape[:2]), bins[x].sum(axis=2)], axis=2)
        ahead, back = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = first + score[:, 0]
        for t in range(1, longest):
            k = live[t]
            ahead[:k, t] = score[:k, t] + np.logaddexp(ahead[:k, t - 1, :1] + pairs[0], ahead[:k, t - 1, 1:] + pairs[1])
        for t in range(longest - 2, -1, -1):
            k = live[t + 1]
            after = score[:k, t + 1] + back[:k, t + 1]
            back[:k, t] = np.logaddexp(pairs[:, 0] + after[:, :1], pairs[:, 1] + after[:, 1:])
        total = np.logaddexp(*ahead[np.arange(len(n)), n - 1].T)
        grad = np.zeros_like(weights)
        for t in range(longest):
            k = live[t]
            p = np.exp(ahead[:k, t, 1] + back[:k, t, 1] - total[:k])
            np.add.at(grad[:N_BINS], x[:k, t].ravel(), np.repeat(y[:k] - p, x.shape[2]))
            if t == 0:
                grad[N_BINS + 4 :] += [(p - y[:k]).sum(), (y[:k] - p).sum()]
            else:
                both = ahead[:k, t - 1, :, None] + pairs + (score[:k, t] + back[:k, t])[:, None, :]
                expect = np.exp(both - total[:k, None, None]).sum(axis=0)
                grad[N_BINS : N_BINS + 4] += (np.array([[(y[:k] == 0).sum(), 0], [0, (y[:k] == 1).sum()]]) - expect).ravel()
        grad = grad / n.sum() - RIDGE * weights
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        weights = weights + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return LineField(weights[:N_BINS], weights[N_BINS : N_BINS + 4].reshape(2, 2), weights[N_BINS + 4 :])


def decode(field: LineField, bins: np.ndarray) -> list[int]:
    """The likeliest labels of a text's lines (Viterbi)."""
    (p00, p01), (p10, p11) = field.pairs.tolist()
    scores = field.bins[bins].sum(axis=1).tolist()
    a, b = float(field.first[0]), float(field.first[1]) + scores[0]
    came: list[tuple[int, int]] = []
    for s in scores[1:]:
        to0, to1 = (a + p00 >= b + p10), (a + p01 >= b + p11)
        came.append((0 if to0 else 1, 0 if to1 else 1))
        a, b = (a + p00 if to0 else b + p10), (a + p01 if to1 else b + p11) + s
    labels = [0 if a >= b else 1]
    for c in reversed(came):
        labels.append(c[labels[-1]])
    return labels[::-1]


def spaced(bins: np.ndarray) -> np.ndarray:
    """All lines, or SEQUENCES sequences of them, evenly spaced."""
    if len(bins) <= SEQUENCES * SEQUENCE:
        return bins
    starts = np.linspace(0, len(bins) - SEQUENCE, SEQUENCES).astype(int)
    return bins[(starts[:, None] + np.arange(SEQUENCE)).ravel()]


def fit(docs: DataFrame, labels: DataFrame) -> LineField | None:
    """Learn from the SAMPLE_DOCS labelled documents whose doc_id hashes lowest; None unless both labels occur.

    labels: doc_id and quality (1 content, 0 boilerplate); a document with both counts as boilerplate. Of rows that share a
    doc_id one is learnt from, and of a text of more than SEQUENCES * SEQUENCE lines so many sequences, evenly spaced.
    """
    ship(docs.sparkSession)
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [spaced(line_features(t.split(b"\n"))[0]).tobytes() for t in column(part, "text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("quality"), pa.array(rows, pa.binary())], ["doc_id", "quality", "bins"])

    drawn = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(known), "doc_id")  # SAMPLE_DOCS rows
    drawn = drawn.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").cast("int").alias("quality"))
    rows = drawn.mapInArrow(run, "doc_id long, quality int, bins binary").collect()
    rows = sorted((r["doc_id"], r["quality"], bytes(r["bins"])) for r in rows)
    sequences = [(np.frombuffer(b, np.int16).reshape(-1, len(BINS) + len(FLAGS)), int(q != 1)) for _, q, b in rows]
    return train(sequences) if len({y for _, y in sequences}) == 2 else None


def base_counts(text: bytes, lines: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    chars = len(b"".join(words).decode())
    symbols = sum(map(text.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    seen, dups = set(), 0
    for line in lines:
        if line in seen:
            dups += bool(line.split())
        else:
            seen.add(line)
    covered = 0
    if len(words) >= 4:
        h = rolled(word_hashes(words), 3)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        if same.any():
            twice = np.zeros(len(h), bool)
            twice[order[np.r_[same, False] | np.r_[False, same]]] = True
            cover = np.zeros(len(words), bool)
            for k in range(3):
                cover[k : len(h) + k] |= twice
            covered = int(cover.sum())
    return len(words), chars, symbols, dups, covered


def quality(docs: DataFrame, field: LineField | None, content_share: float = CONTENT_SHARE, keep_spans: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id, the base counts, base_failed, kept, content_words; with keep_spans line_labels.

    docs: doc_id and text; other columns are ignored. Words and lines are those of the whole text; null text has none, and
    fails. base_failed: fewer than 50 words, or more than half of them in 3-word windows that occur twice or more. Any other
    text is kept when at least content_share of its words are in content lines; without a field all lines are content.
    Repeated rows are judged alike, a null doc_id like any other. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)  # a few dozen weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            for part in slices(batch):
                rows, spans = [], []
                for text in column(part, "text"):
                    lines = text.split(b"\n")
                    base = base_counts(text, lines)
                    bins, words = line_features(lines)
                    labels = decode(f, bins) if f else [0] * len(lines)
                    failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
                    content = sum(n for n, y in zip(words, labels, strict=True) if not y)
                    rows.append((*base, failed, not failed and content >= content_share * base[0], content))
                    spans.append(labels)
                n = [pa.array(c) for c in zip(*rows, strict=True)]
                cols = [part.column("doc_id").cast(pa.int64()), *(c.cast(pa.int64()) for c in n[:5]), n[5], n[6], n[7].cast(pa.int64())]
                names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_words"]
                if keep_spans:
                    cols.append(pa.array(spans, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, [*names, "line_labels"][: len(cols)])

    schema = COUNTS + ", base_failed boolean, kept boolean, content_words long" + ", line_labels array<int>" * keep_spans
    return docs.select("doc_id", "text").mapInArrow(run, schema)
