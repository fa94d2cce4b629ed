"""Token counts by the unigram model, without making the tokens.

The vocabulary file's pieces and scores serve as a unigram vocabulary, as in
tokenizers.models.Unigram(pieces, unk_id=0, byte_fallback=True): white space marks stand for
spaces, one more goes before the text, and the best-scored segmentation counts. (The file
was made for merges; read as a unigram vocabulary it gives segmentations of its own.)

An Aho-Corasick automaton enumerates the pieces that end at each place; a pass over the
matches carries the best score and the count of pieces to each place. Ties go as in the
library: of the pieces that end in one place the first start wins, that is the longest
piece, and an unknown character (10 below the lowest score, counted as its UTF-8 bytes) loses
to all. No piece goes on over a mark, and some characters (line ends) are in no piece, so the
best segmentation of a text is made up of those of its words: only distinct words are scored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trackloom.llm import common, tokens

MARK = "▁"


class Counter:
    """Counts pieces of words; one for each worker process and vocabulary."""

    def __init__(self, path: str, slots: int = 1 << 21):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.vocabulary = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p, _ in self.vocabulary):
            raise ValueError("a piece goes on over a mark")
        if any(c in p for p, _ in self.vocabulary for c in "\n\t"):
            raise ValueError("a piece holds a line end or a tab")
        self.machine = ahocorasick.Automaton()
        self.single = set()
        for p, s in self.vocabulary:
            if p and not self.machine.exists(p):
                self.machine.add_word(p, (len(p), s))
            if len(p) == 1:
                self.single.add(p)
        self.machine.make_automaton()
        self.unknown = min(s for _, s in self.vocabulary) - 10.0
        self.slots = slots
        self.table = tokens.WordTable(slots)

    def counts(self, segments: list[str]) -> list[int]:
        """Pieces of each segment; none holds a line end. All go through the automaton as one
        text, with line ends between them."""
        text = "\n".join(segments)
        n = len(text)
        low = float("-inf")
        best, count = [low] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        single, unknown = self.single, self.unknown
        done = 0  # places up to here are settled

        def pass_unknown(stop: int, done: int) -> None:
            for i in range(done, stop):  # a place may be reached by an unknown character
                c = text[i]
                if c not in single:
                    if c == "\n":
                        best[i + 1], count[i + 1] = 0.0, count[i]
                    elif best[i] + unknown > best[i + 1]:
                        best[i + 1], count[i + 1] = best[i] + unknown, count[i] + len(c.encode("utf-8", "surrogatepass"))

        for last, (length, score) in self.machine.iter(text):
            if last > done:
                pass_unknown(last, done)
                done = last
            start = last + 1 - length
            got = best[start] + score
            if got > best[last + 1]:
                best[last + 1], count[last + 1] = got, count[start] + 1
        pass_unknown(n, done)
        out, at = [], 0
        for s in segments:
            out.append(count[at + len(s)] - count[at])
            at += len(s) + 1
        return out

    def texts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Pieces of each text, for texts that stand end to end."""
        n = len(off) - 1
        out = np.zeros(n, np.int64)
        if not len(data):
            return out
        starts, ends = tokens.words(data, off)
        doc = np.searchsorted(off, starts, side="right") - 1
        other = (data == 9) | (data == 10)
        out += np.add.reduceat(np.r_[other, False].astype(np.int64), off[:-1]) * (np.diff(off) > 0)
        # Marks before each word: the run of spaces that ends there, and one more if it begins the text.
        space = data == 32
        black = np.flatnonzero(~space)
        run_start = np.r_[0, black + 1][np.searchsorted(black, starts)]  # after the last byte that is no space
        run_start = np.maximum(run_start, off[doc])
        marks = starts - run_start + (run_start == off[doc])
        prints = tokens.word_prints(data, starts, ends) ^ (marks.astype(np.uint64) << np.uint64(17))
        prints |= np.uint64(1)
        slot = self.table.find(prints)
        miss = np.flatnonzero(slot < 0)
        if len(miss):
            fresh, first = np.unique(prints[miss], return_index=True)
            if self.table.used + len(fresh) > self.table.most:
                self.table = tokens.WordTable(max(self.slots, 1 << (4 * len(prints)).bit_length()))
                return self.texts(data, off)
            raw, at = data.tobytes(), miss[first]
            new = [MARK * m + raw[a:b].decode() for m, a, b in zip(marks[at].tolist(), starts[at].tolist(), ends[at].tolist(), strict=True)]
            got = [c for k in range(0, len(new), 20_000) for c in self.counts(new[k : k + 20_000])]
            self.table.add(fresh, [np.asarray([c], "<u4").tobytes() for c in got])
            slot[miss] = self.table.find(prints[miss])
        out += np.bincount(doc, self.table.ids[self.table.begin[slot]], n).astype(np.int64)
        # Runs of spaces that no word follows: before a line end or tab, or at a text's end.
        final = np.zeros(len(data) + 1, bool)
        final[off] = True
        alone = np.flatnonzero(space & (final[1:] | np.r_[other[1:], False]))
        for e in alone.tolist():
            d = int(np.searchsorted(off, e, side="right")) - 1
            a = e
            while a > off[d] and space[a - 1]:
                a -= 1
            out[d] += self.counts([MARK * int(e + 1 - a + (a == off[d]))])[0]
        # A text that begins with a line end has its first mark alone.
        filled = np.flatnonzero(np.diff(off) > 0)
        out[filled[other[off[:-1][filled]]]] += 1
        # Some pieces hold \r, \v or \f, which count as white space above, and a mark may stand
        # in the text itself: such texts anew.
        rare = np.flatnonzero((data >= 11) & (data <= 13) | (data == 0xE2) & (np.r_[data[1:], 0] == 0x96) & (np.r_[data[2:], 0, 0][: len(data)] == 0x81))
        for d in np.unique(np.searchsorted(off, rare, side="right") - 1).tolist():
            out[d] = self.slowly(data[off[d] : off[d + 1]].tobytes().decode("utf-8", "replace"))
        return out

    def slowly(self, text: str) -> int:
        """Pieces of one text, word by word."""
        segments = re.findall(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+", MARK + text.replace(" ", MARK)) if text else []
        return text.count("\n") + sum(sum(self.counts(segments[k : k + 20_000])) for k in range(0, len(segments), 20_000))


_made: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _made:
        _made[path] = Counter(path)
    return _made[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens of every whole text, of any length; null and empty texts have none. Repeated
    rows each give their row, ties go as the tokenizer's rules say, an empty table gives none."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches):
        c = counter(vocabulary)
        for whole in batches:
            for b in common.slices(whole, "text", tokens.AT_ONCE):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c.texts(*common.flat_text(b.column(1))))], ["doc_id", "n_tokens"])

    return common.pick(docs, doc_id="long", text="string").mapInArrow(common.tidy(run), "doc_id long, n_tokens long")


def op7_unigram_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def reference_count(c: Counter, text: str) -> int:
    """The same by the tokenizers library, for tests."""
    from tokenizers import Tokenizer, models

    if not hasattr(c, "library"):
        c.library = Tokenizer(models.Unigram(c.vocabulary, unk_id=0, byte_fallback=True))
    return len(c.library.encode(MARK + re.sub(" ", MARK, text), add_special_tokens=False).ids) if text else 0
