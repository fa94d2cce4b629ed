"""Languages of spans: script ranges, per-word scores, Viterbi with a switching penalty."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm import common, tokens

#: Labelled documents learnt from at most (those with the least hash of doc_id).
SAMPLE = 20_000
#: Buckets of the hashed byte n-grams, and their lengths.
BUCKETS, GRAMS = 1 << 16, (1, 2, 3, 4)
#: What a word can count against a language at most, and what a switch of language costs.
CLIP, SWITCH = 8.0, 10.0

# First code points of Unicode blocks, by script.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"),
    (0x3130, "hangul"), (0x3190, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0xFF21, "latin"),
    (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x30000, "other"),
]
SCRIPT_NAMES = sorted({s for _, s in SCRIPTS})
_FIRST = [a for a, _ in SCRIPTS]
_INDEX = [SCRIPT_NAMES.index(s) for _, s in SCRIPTS]
LATIN = SCRIPT_NAMES.index("latin")
LETTER = np.zeros(256, bool)  # ASCII letters, and bytes of characters beyond ASCII
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters (and of characters beyond ASCII)."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    black = LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    starts, ends = black.copy(), black.copy()
    starts[1:] &= ~black[:-1] | edge[1:-1]
    ends[:-1] &= ~black[1:] | edge[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def script(word: str) -> int:
    """The script of the first letter; -1 without a letter."""
    for c in word:
        if c.isalpha():
            return _INDEX[bisect_right(_FIRST, ord(c)) - 1]
    return -1


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(lower-cased distinct words, index of each run in them, script of each word)."""
    prints = tokens.word_prints(data, starts, ends)
    _, first, inverse = np.unique(prints, return_index=True, return_inverse=True)
    raw = data.tobytes()
    words = b"\n".join([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]).decode("utf-8", "replace").lower().split("\n") if len(first) else []
    scripts = np.asarray([LATIN if w.isascii() else script(w) for w in words], np.int8)
    return words, inverse, scripts


def gram_buckets(words: list[str]):
    """For each n: (start of each word's grams, buckets), with a mark on both sides of a word."""
    text = np.frombuffer(("\n" + "\n".join(words) + "\n").encode(), np.uint8)
    mark = np.flatnonzero(text == 10)
    for n in GRAMS:
        code = np.zeros(max(0, len(text) - n + 1), np.uint32)
        for k in range(n):
            code = code * np.uint32(16777619) ^ (text[k : k + len(code)] + np.uint32(n * 257))
        code = (code ^ (code >> np.uint32(15))) * np.uint32(2654435761)
        bucket = (code >> np.uint32(16)).astype(np.int64) % BUCKETS
        inside = np.ones(len(code), bool)
        for k in range(1, n - 1):  # a mark may stand at an end only
            at = mark - k
            inside[at[(at >= 0) & (at < len(code))]] = False
        if n == 1:
            inside[mark[mark < len(code)]] = False
        yield np.where(inside, bucket, BUCKETS), mark


def word_sums(words: list[str], table: np.ndarray) -> np.ndarray:
    """(words, languages): sums of a table (BUCKETS + 1, languages) over each word's grams."""
    out = np.zeros((len(words), table.shape[1]), np.float32)
    each = max(64, (1 << 21) // max(1, table.shape[1]))  # words at once: fewer where languages are many
    for a in range(0, len(words), each):
        for bucket, mark in gram_buckets(words[a : a + each]):
            total = np.concatenate([np.zeros((1, table.shape[1]), np.float64), np.cumsum(table[bucket], axis=0, dtype=np.float64)])
            last = len(bucket)
            out[a : a + each] += total[np.minimum(mark[1:], last)] - total[np.minimum(mark[:-1], last)]
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (BUCKETS + 1, languages): log probabilities; the last row is zero
    candidates: np.ndarray  # (scripts, languages): which languages a script leaves

    def scores(self, words: list[str], scripts: np.ndarray) -> np.ndarray:
        got = word_sums(words, self.table)
        if not len(words):
            return got
        got = np.maximum(got - got.max(axis=1, keepdims=True), -CLIP)
        known = scripts >= 0
        got[known] = np.where(self.candidates[scripts[known]], got[known], -2 * CLIP)
        got[known] -= got[known].max(axis=1, keepdims=True)
        got[~known] = 0
        return got


def train(docs: DataFrame, sample: int = SAMPLE, folds: int = 5) -> Model:
    """Learn from text and lang of at most `sample` documents outside the held-out fold (those
    with the least hash of doc_id), and so of all languages that these have, any number of them."""
    spark = docs.sparkSession
    known = common.pick(docs, doc_id="long", lang="string", text="string").where("lang is not null and text is not null").where(common.crc_fold(folds=folds) != 0)
    total = known.count()
    if total > sample:  # the share of all hashes that leaves about the sample, and no more than it
        cut = known.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
        known = known.where(F.xxhash64("doc_id") <= cut)
    languages = sorted(r.lang for r in known.select("lang").distinct().collect())  # of `sample` documents at most
    if not languages:
        return Model([], np.zeros((BUCKETS + 1, 0)), np.zeros((len(SCRIPT_NAMES), 0), bool))

    place = {x: k for k, x in enumerate(languages)}

    def count(batches):
        seen = np.zeros((BUCKETS + 1, len(languages)))
        letters = np.zeros((len(SCRIPT_NAMES), len(languages)))
        for whole in batches:
            for b in common.slices(whole, "text", 2 << 20):
                data, off = common.flat_text(b.column(1))
                starts, ends = runs(data, off)
                words, inverse, scripts = distinct_words(data, starts, ends)
                doc = np.searchsorted(off, starts, side="right") - 1
                lang = np.asarray([place[x] for x in b.column(0).to_pylist()], np.int64)[doc] if len(doc) else np.zeros(0, np.int64)
                for k in np.unique(lang).tolist():
                    times = np.bincount(inverse[lang == k], minlength=len(words)).astype(float)
                    for bucket, mark in gram_buckets(words):
                        span = np.diff(np.minimum(mark, len(bucket)))
                        seen[:, k] += np.bincount(bucket[mark[0] :][: span.sum()], np.repeat(times, span), BUCKETS + 1)
                    ok = scripts >= 0
                    letters[:, k] += np.bincount(scripts[ok], (times * [len(w) for w in words])[ok], len(SCRIPT_NAMES))
        for k in range(len(languages)):
            for kind, column in ((0, seen[:-1, k]), (1, letters[:, k])):
                live = np.flatnonzero(column)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(live), kind), pa.int32()), pa.array(np.full(len(live), k), pa.int32()), pa.array(live, pa.int32()), pa.array(column[live])], ["kind", "lang", "place", "n"])

    # At most (BUCKETS + scripts) rows for each language.
    rows = known.select("lang", "text").mapInArrow(common.tidy(count), "kind int, lang int, place int, n double").groupBy("kind", "lang", "place").agg(F.sum("n").alias("n")).toArrow()
    kind, lang, place, n = (np.asarray(rows.column(c).combine_chunks()) for c in ("kind", "lang", "place", "n"))
    seen, letters = np.zeros((BUCKETS, len(languages))), np.zeros((len(SCRIPT_NAMES), len(languages)))
    seen[place[kind == 0], lang[kind == 0]] = n[kind == 0]
    letters[place[kind == 1], lang[kind == 1]] = n[kind == 1]
    table = np.log((seen + 0.5) / (seen.sum(axis=0) + 0.5 * BUCKETS))
    share = letters / np.maximum(letters.sum(axis=0), 1)
    candidates = share >= 0.005
    candidates[~candidates.any(axis=1)] = True  # a script never seen leaves all of them
    return Model(languages, np.concatenate([table, np.zeros((1, len(languages)))]), candidates)


def viterbi(scores: np.ndarray, first: np.ndarray, count: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word. Document i has the words first[i] to first[i] + count[i];
    all documents go side by side, a word of each at a time."""
    kind = np.min_scalar_type(max(1, scores.shape[1] - 1))
    label = np.zeros(len(scores), kind)
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    if not len(count) or count[0] == 0:
        return label
    width = np.searchsorted(-count, -np.arange(count[0]), side="left")  # documents with more than t words
    back = np.zeros(scores.shape, kind)
    own = np.arange(scores.shape[1], dtype=kind)[None, :]
    v = scores[first[: width[0]]].astype(np.float64)
    end = np.zeros(len(count), kind)
    for t in range(1, count[0]):
        n = width[t]
        if n < len(v):
            end[n : len(v)] = v[n:].argmax(axis=1)
            v = v[:n]
        best = v.argmax(axis=1)
        move = v[np.arange(n), best] - switch
        stay = v >= move[:, None]
        at = first[:n] + t
        back[at] = np.where(stay, own, best[:, None])
        v = np.where(stay, v, move[:, None]) + scores[at]
        v -= v.max(axis=1, keepdims=True)
    end[: len(v)] = v.argmax(axis=1)
    state = end
    for t in range(count[0] - 1, -1, -1):
        n = width[t]
        at = first[:n] + t
        label[at] = state[:n]
        if t:
            state[:n] = back[at, state[:n]]
    return label


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text -> doc_id, lang_pred, score, spans (start, end in bytes, lang).

    A word is a run of letters. lang_pred is the language of most bytes of words (ties: the
    first by name), score its share. Null texts and texts without a letter: und, 0, no spans.
    Texts of any length are read whole, repeated rows each give their row, an empty table gives
    none, extra columns aren't read.
    """
    names = pa.array([*model.languages, "und"])
    und = len(model.languages)
    share = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = share.value
        for whole in batches:
            for b in common.slices(whole, "text", max(1 << 14, (3 << 20) * 8 // max(8, und))):
                data, off = common.flat_text(b.column(1))
                n = b.num_rows
                starts, ends = runs(data, off)
                words, inverse, scripts = distinct_words(data, starts, ends)
                real = (scripts >= 0)[inverse] if len(words) else np.zeros(0, bool)
                starts, ends, inverse = starts[real], ends[real], inverse[real]
                edge = np.searchsorted(starts, off)
                doc = np.repeat(np.arange(n), np.diff(edge))
                if und:
                    label = viterbi(m.scores(words, scripts)[inverse], edge[:-1], np.diff(edge))
                    mass = np.bincount(doc * und + label, (ends - starts).astype(float), n * und).reshape(n, und)
                    total = mass.sum(axis=1)
                    pred = np.where(total > 0, mass.argmax(axis=1), und)
                    score = np.where(total > 0, mass.max(axis=1) / np.maximum(total, 1), 0.0)
                else:
                    label, pred, score = np.zeros(len(starts), np.uint8), np.full(n, und), np.zeros(n)
                    starts, ends, label, doc = starts[:0], ends[:0], label[:0], doc[:0]
                new = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])]) if len(label) else np.zeros(0, np.int64)
                last = np.r_[new[1:], len(label)] - 1
                begin = off[:-1][doc[new]]
                lists = np.searchsorted(doc[new], np.arange(n + 1)).astype(np.int32)
                spans = pa.ListArray.from_arrays(pa.array(lists), pa.StructArray.from_arrays([pa.array(starts[new] - begin), pa.array(ends[last] - begin if len(new) else begin), names.take(pa.array(label[new]))], ["start", "end", "lang"]))
                yield pa.RecordBatch.from_arrays([b.column(0), names.take(pa.array(pred)), pa.array(score), spans], ["doc_id", "lang_pred", "score", "spans"])

    return common.pick(docs, doc_id="long", text="string").mapInArrow(common.tidy(run), "doc_id long, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>")


def op3_language_viterbi(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, train(docs))
    return found.select("doc_id", (common.crc_fold() == 0).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
