"""Language identification of spans: script ranges narrow candidates, Viterbi over per-word scores labels mixed text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, text_slices

UNKNOWN = "und"
#: Ranges of code points of the scripts, and the language of a script for which no language was trained.
SCRIPTS = {
    "Latin": ([(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF)], UNKNOWN),
    "Greek": ([(0x370, 0x3FF), (0x1F00, 0x1FFF)], "el"),
    "Cyrillic": ([(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)], "ru"),
    "Armenian": ([(0x530, 0x58F)], "hy"),
    "Hebrew": ([(0x590, 0x5FF)], "he"),
    "Arabic": ([(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)], "ar"),
    "Devanagari": ([(0x900, 0x97F)], "hi"),
    "Bengali": ([(0x980, 0x9FF)], "bn"),
    "Tamil": ([(0xB80, 0xBFF)], "ta"),
    "Thai": ([(0xE00, 0xE7F)], "th"),
    "Georgian": ([(0x10A0, 0x10FF)], "ka"),
    "Hangul": ([(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)], "ko"),
    "Kana": ([(0x3040, 0x30FF), (0x31F0, 0x31FF)], "ja"),
    "Han": ([(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)], "zh"),
}
FORBIDDEN = -1e6
_SCRIPT = np.zeros(0x30000, np.uint8)  # 1 and more: the scripts in order, for letters
for _i, (_ranges, _) in enumerate(SCRIPTS.values(), 1):
    for _a, _b in _ranges:
        _SCRIPT[_a : _b + 1] = [_i * chr(c).isalpha() for c in range(_a, _b + 1)]


def marked(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of the words with ^ before and $ after each, and where each begins."""
    chars = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le"), np.uint32)
    return chars, np.concatenate(([0], np.cumsum([len(w) + 2 for w in words]))).astype(np.int64)


def scripts_of(chars: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each word the script of most of its letters (the first in order of equals), 0 without letters of a known script."""
    n = len(SCRIPTS) + 1
    own = np.where(chars < len(_SCRIPT), _SCRIPT[np.minimum(chars, len(_SCRIPT) - 1)], 0).astype(np.int64)
    found = np.bincount(np.repeat(np.arange(len(begin) - 1), np.diff(begin)) * n + own, minlength=(len(begin) - 1) * n).reshape(-1, n)
    found[:, 0] = 0
    return found.argmax(axis=1)


def trigrams(chars: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of each word, three characters in 63 bits, and where each word's begin; a word has as many as characters."""
    c = chars.astype(np.uint64)
    size = np.diff(begin) - 2
    first = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(first[-1]) + np.repeat(begin[:-1] - first[:-1], size)
    return (c[at] << np.uint64(42)) | (c[at + 1] << np.uint64(21)) | c[at + 2], first


class Model:
    """Log probabilities of trigrams in each trained language.  Labels are these, then languages of scripts, then unknown."""

    def __init__(self, counts: dict[str, dict[int, int]], smoothing: float = 0.5) -> None:
        self.trained = sorted(counts)
        self.keys = np.array(sorted({g for c in counts.values() for g in c}), np.uint64)
        n = np.array([[counts[k].get(g, 0) for k in self.trained] for g in self.keys.tolist()], np.float64).reshape(len(self.keys), len(self.trained))
        total = n.sum(axis=0) + smoothing * (len(self.keys) + 1)
        table = np.log((n + smoothing) / total)
        floor = np.log(smoothing / total)
        self.table = np.vstack((table, floor[None])).astype(np.float32)
        #: A trigram of unknown text scores between what is typical and what was never seen, nearer to the latter.
        typical = (n * table).sum(axis=0) / np.maximum(n.sum(axis=0), 1)
        self.unknown = float(0.3 * np.mean(typical) + 0.7 * np.mean(floor)) if len(self.trained) else 0.0
        self.labels = [*self.trained, *sorted({d for _, d in SCRIPTS.values()} - {*self.trained, UNKNOWN}), UNKNOWN]
        #: Languages that have one in twenty of their letters in a script are its candidates; without any it has a language of its own.
        self.candidates = np.zeros((len(SCRIPTS) + 1, len(self.trained)), bool)
        middle = (self.keys >> np.uint64(21)) & np.uint64(0x1FFFFF)
        script = np.where(middle < len(_SCRIPT), _SCRIPT[np.minimum(middle, len(_SCRIPT) - 1).astype(np.int64)], 0)
        letters = np.maximum(n[script > 0].sum(axis=0), 1)
        for i in range(1, len(SCRIPTS) + 1):
            seen = n[script == i].sum(axis=0)
            self.candidates[i] = (seen > 0) & (seen >= 0.05 * letters)
        self.own = [self.labels.index(d) for _, d in SCRIPTS.values()]

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each word under each label, and whether it has letters.  Candidates outside its script are forbidden;
        words without letters are the same under all."""
        chars, begin = marked(words)
        script = scripts_of(chars, begin)
        g, first = trigrams(chars, begin)
        size = np.diff(first)
        out = np.full((len(words), len(self.labels)), FORBIDDEN, np.float32)
        if len(self.trained) and len(g):
            at = np.minimum(np.searchsorted(self.keys, g), max(len(self.keys) - 1, 0))
            at = np.where(self.keys[at] == g, at, len(self.keys)) if len(self.keys) else np.zeros(len(g), np.int64)
            total = np.add.reduceat(self.table[at], first[:-1], axis=0)
            out[:, : len(self.trained)] = np.where(self.candidates[script], total, FORBIDDEN)
        bare = (script > 0) & ~self.candidates[script].any(axis=1)
        if bare.any():
            which = np.flatnonzero(bare)
            out[which, np.array([len(self.labels) - 1, *self.own])[script[which]]] = self.unknown * size[which] / 2
        out[:, -1] = self.unknown * size
        out[script == 0] = 0
        return out, script > 0


def _excursion(s: np.ndarray, row: np.ndarray, of: np.ndarray, best: np.ndarray) -> np.ndarray:
    """For each text the most that any label gains over the text's best label on a stretch of words."""
    gain = np.zeros(len(row) - 1)
    base = s[np.arange(len(of)), best[of]]
    full = np.flatnonzero(np.diff(row) > 0)
    first = np.zeros(len(of), bool)
    first[row[:-1][full]] = True
    shift = of * 1e9  # later texts lie lower, so the running minimum begins anew
    for j in range(s.shape[1]):
        d = np.clip(s[:, j] - base, -1e4, 1e4).astype(np.float64)
        c = np.cumsum(d)
        c -= (c[row[:-1][full]] - d[row[:-1][full]])[np.searchsorted(full, of)]  # from each text's start
        before = np.where(first, 0.0, np.concatenate(([0.0], c[:-1])))
        low = np.minimum.accumulate(before - shift) + shift
        gain[full] = np.maximum(gain[full], np.maximum.reduceat(c - low, row[:-1][full]))
    return gain


def viterbi(s: np.ndarray, begin: np.ndarray, end: np.ndarray, penalty: float) -> list[np.ndarray]:
    """For each text, words ``begin`` to ``end`` (longest first), the labels that maximise the scores less the penalty for each
    change; the lowest label of equals.  All texts advance together by a word."""
    k = s.shape[1]
    length = end - begin
    back = np.empty((int(length.sum()), k), np.int8)
    active = np.searchsorted(-length, -np.arange(length[0]), "left")  # texts with more than t words
    v = s[begin].astype(np.float64)
    stay = np.arange(k, dtype=np.int8)
    row = np.concatenate(([0], np.cumsum(active))).tolist()
    final = np.empty(len(begin), np.int64)
    for t in range(1, int(length[0])):
        m = int(active[t])
        if m < len(v):
            final[m : len(v)] = v[m:].argmax(axis=1)
            v = v[:m]
        top = v.argmax(axis=1)
        best = v[np.arange(m), top][:, None] - penalty
        switch = best > v
        back[row[t] : row[t] + m] = np.where(switch, top[:, None], stay)
        v = np.where(switch, best, v) + s[begin[:m] + t]
    final[: len(v)] = v.argmax(axis=1)
    state = np.zeros(len(begin), np.int64)
    flat = np.empty(int(length.sum()), np.int8)
    at = np.concatenate(([0], np.cumsum(length)))
    for t in range(int(length[0]) - 1, -1, -1):
        m = int(active[t])
        done = int(active[t + 1]) if t + 1 < length[0] else 0
        state[done:m] = final[done:m]
        flat[at[:m] + t] = state[:m]
        if t:
            state[:m] = back[row[t] + np.arange(m), state[:m]]
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


def label_words(s: np.ndarray, row: np.ndarray, of: np.ndarray, penalty: float) -> np.ndarray:
    """The label of each word.  Where no stretch gains more than half the penalty over the text's best label, that label holds
    throughout: a path with m stretches in other labels has at least m / 2 changes (m - 1, and 1 if m is 1, unless it is one
    label throughout, which can't beat the best).  The others go through ``viterbi``."""
    if not len(s):
        return np.zeros(0, np.int8)
    starts = np.flatnonzero(np.diff(row) > 0)
    total = np.zeros((len(row) - 1, s.shape[1]))
    total[starts] = np.add.reduceat(s.astype(np.float64), row[:-1][starts], axis=0)
    best = total.argmax(axis=1)
    out = best[of].astype(np.int8)
    mixed = np.flatnonzero(_excursion(s, row, of, best) > penalty / 2)
    if len(mixed):
        mixed = mixed[np.argsort(row[mixed] - row[mixed + 1], kind="stable")]
        for i, found in zip(mixed.tolist(), viterbi(s, row[mixed], row[mixed + 1], penalty)):
            out[row[i] : row[i + 1]] = found
    return out


def train(docs: DataFrame, per_language: int = 400, least: int = 2) -> Model:
    """A model from at most ``per_language`` documents of each language in ``lang``, the first in order of a hash of their ids.

    Trigrams seen fewer than ``least`` times in a language are left out.  Rows with a null id, text or lang don't count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        langs: list[str] = []
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = Words(pa.array([text]))
                chars, begin = marked(w.strings(np.arange(len(w.start))))
                g, first = trigrams(chars, begin)
                keys.append(g[np.repeat(scripts_of(chars, begin) > 0, np.diff(first))])
                langs.append(lang)
        for lang in sorted(set(langs)):
            g, n = np.unique(np.concatenate([k for k, own in zip(keys, langs) if own == lang]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).filter("doc_id is not null and lang is not null")
    rank = F.expr(f"row_number() over (partition by lang order by xxhash64(doc_id), doc_id) <= {int(per_language)}")
    chosen = known.withColumn("__in", rank).filter("__in").select("doc_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sample = texts.filter("lang is not null and text is not null").join(F.broadcast(chosen), "doc_id").select("lang", "text")
    counted = sample.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    counts: dict[str, dict[int, int]] = {}
    for lang, gram, n in counted.collect():  # bounded by the sample
        counts.setdefault(lang, {})[gram] = n
    return Model(counts)


def language_spans(docs: DataFrame, model: Model, penalty: float = 20.0, most_unknown: float = 0.5) -> DataFrame:
    """Spans of one language: ``doc_id, span, first_word, n_words, lang, doc_lang, kept``, in order of the words.

    ``doc_lang`` is the language of most words with letters (the first in the model's order of equals).  A document is kept
    unless it has no such word or more than ``most_unknown`` of them are unknown ('und').  A text without words, also an empty or
    null one, gives one span of 0 words in 'und', not kept; an empty table gives no rows.  Texts of any length are labelled as a
    whole.  Ids may be null or repeated; other columns are ignored, whatever their names."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch, texts in text_slices(batches, "text"):
            w = Words(texts)
            h, of, row = w.hash, w.of, w.row
            _, first, code = np.unique(h, return_index=True, return_inverse=True)
            names = w.strings(first)
            scores, letters = m.scores(names)
            used = np.flatnonzero((scores > FORBIDDEN / 2).any(axis=0)) if len(names) else np.array([len(m.labels) - 1])
            label = used[label_words(scores[:, used][code], row, of, penalty)]
            n = np.bincount(of[letters[code]] * len(m.labels) + label[letters[code]], minlength=len(texts) * len(m.labels)).reshape(len(texts), -1)
            doc = np.where(n.sum(axis=1) > 0, n.argmax(axis=1), len(m.labels) - 1)
            kept = (n.sum(axis=1) > 0) & (n[:, -1] <= most_unknown * n.sum(axis=1))
            change = np.ones(len(h), bool)
            change[1:] = (label[1:] != label[:-1]) | (of[1:] != of[:-1])
            at = np.flatnonzero(change)
            size = np.diff(np.concatenate((at, [len(h)])))
            empty = np.flatnonzero(np.diff(row) == 0)
            text_of = np.concatenate((of[at], empty))
            begin = np.concatenate((at - row[of[at]], 0 * empty))
            length = np.concatenate((size, 0 * empty))
            lang = np.concatenate((label[at], 0 * empty + len(m.labels) - 1)).astype(np.int64)
            order = np.lexsort((begin, text_of))
            text_of, begin, length, lang = text_of[order], begin[order], length[order], lang[order]
            span = np.arange(len(text_of)) - np.searchsorted(text_of, text_of)
            names_ = pa.array(m.labels)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(text_of)), pa.array(span, pa.int64()), pa.array(begin, pa.int64()), pa.array(length, pa.int64()), names_.take(pa.array(lang)), names_.take(pa.array(doc[text_of].astype(np.int64))), pa.array(kept[text_of])],
                names=["doc_id", "span", "first_word", "n_words", "lang", "doc_lang", "kept"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, span long, first_word long, n_words long, lang string, doc_lang string, kept boolean")


def keep_identified(docs: DataFrame, model: Model, penalty: float = 20.0, most_unknown: float = 0.5) -> DataFrame:
    """The rows that ``language_spans`` keeps, without a shuffle: each batch is judged where it is.

    A string column ``lang`` is set to the language of most of a text's words; all other columns stay, whatever their names.  Rows
    whose text is null, empty or has no words with letters go, as do those of which most words are unknown; ids may be null or
    repeated, texts of any length are judged as a whole, and an empty table stays one."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    named = [i for i, f in enumerate(docs.schema) if f.name == "lang" and f.dataType.typeName() == "string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = pa.array(m.labels)
        for batch in batches:
            keep, label = [np.zeros(0, bool)], [np.zeros(0, np.int64)]
            for _, texts in text_slices(iter([pa.RecordBatch.from_arrays([batch.column(at)], names=["text"])]), "text"):
                kept, found = judge(m, texts, penalty, most_unknown)
                keep.append(kept)
                label.append(found)
            columns = list(batch.columns)
            for i in named:
                columns[i] = names.take(pa.array(np.concatenate(label))).cast(batch.column(i).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)


def judge(m: Model, texts: pa.Array, penalty: float, most_unknown: float) -> tuple[np.ndarray, np.ndarray]:
    """Which texts are kept, and the label of most of their words."""
    w = Words(texts)
    _, first, code = np.unique(w.hash, return_index=True, return_inverse=True)
    names = w.strings(first)
    k = len(m.labels)
    if not names:
        return np.zeros(len(texts), bool), np.full(len(texts), k - 1)
    scores, letters = m.scores(names)
    used = np.flatnonzero((scores > FORBIDDEN / 2).any(axis=0))
    label = used[label_words(scores[:, used][code], w.row, w.of, penalty)]
    n = np.bincount(w.of[letters[code]] * k + label[letters[code]], minlength=len(texts) * k).reshape(len(texts), k)
    total = n.sum(axis=1)
    return (total > 0) & (n[:, -1] <= most_unknown * total), np.where(total > 0, n.argmax(axis=1), k - 1)
