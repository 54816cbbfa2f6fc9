"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a word form a linked list; a heap holds the adjacent pairs whose
concatenation is a piece, lowest rank first and leftmost among equals.  Popping
a live pair joins it and pushes its two new pairs.  The count is the initial
symbols minus the merges (a symbol left that is no piece counts its UTF-8 bytes,
the model's byte fallback); no identifier is ever made."""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from sparkjourney.llm.common import Memo, in_pieces, texts, tidy

SPACE = "▁"
REMEMBERED = 48


def piece_ranks(model: bytes) -> dict[str, float]:
    """Rank of every piece that merging can make (lower first), of a sentencepiece BPE model."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor()
    p.LoadFromSerializedProto(model)
    skip = lambda i: p.IsUnknown(i) or p.IsControl(i) or p.IsByte(i)
    return {p.IdToPiece(i): -p.GetScore(i) for i in range(p.GetPieceSize()) if not skip(i)}


class Counter:
    def __init__(self, rank: dict[str, float]):
        self.rank = rank
        self.inner = any(SPACE in piece.lstrip(SPACE) for piece in rank)  # then a merge may cross a word's start
        self.runs = re.compile(f"{SPACE}+[^{SPACE}]*")
        #: adjacent characters that some piece holds; a text splits between any others
        self.adjacent = {pair for piece in rank for pair in zip(piece, piece[1:])}
        self.lonely = {c for c in "\n.," if not any(c in pair for pair in self.adjacent)}
        self.word = Memo(self._word, 64 << 20)
        self.run = Memo(self.merged, 32 << 20)

    def merged(self, text: str) -> int:
        """Number of tokens of one text into which no merge reaches from outside."""
        rank, sym = self.rank, list(text)
        n = len(sym)
        heap = []
        for i in range(n - 1):
            r = rank.get(sym[i] + sym[i + 1])
            if r is not None:
                heap.append((r, i, sym[i] + sym[i + 1]))
        count = n
        if heap:
            heapq.heapify(heap)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            while heap:
                _, i, piece = heapq.heappop(heap)
                j = after[i]
                if sym[i] is None or j >= n or sym[i] + sym[j] != piece:
                    continue  # one of the two has merged since
                sym[i], sym[j] = piece, None
                count -= 1
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    r = rank.get(piece + sym[k])
                    if r is not None:
                        heapq.heappush(heap, (r, i, piece + sym[k]))
                k = before[i]
                if k >= 0:
                    r = rank.get(sym[k] + piece)
                    if r is not None:
                        heapq.heappush(heap, (r, k, sym[k] + piece))
        for s in sym:
            if s is not None and s not in rank:
                count += len(s.encode("utf-8", "surrogatepass")) - 1
        return count

    def _word(self, word: str) -> int:
        """Tokens of the mark and a word, cut where no piece can reach across."""
        if "\n" in word and "\n" in self.lonely:
            first, *rest = word.split("\n")
            return self.word[first] + sum(self.run["\n"] + self.run[r] for r in rest)
        if word[-2:-1] and word[-1] in ".," and (word[-2], word[-1]) not in self.adjacent:
            return self.word[word[:-1]] + self.run[word[-1]]
        return self.merged(SPACE + word)

    def count(self, text: str) -> int:
        """A space becomes the mark, one mark comes first; every run of marks starts a new word."""
        if not text:
            return 0
        if self.inner:
            return self.merged(SPACE + text.replace(" ", SPACE))
        words = text.replace(SPACE, " ").split(" ")
        if "" not in words:
            remembered = self.word
            return sum([remembered[w] if len(w) <= REMEMBERED else self.merged(SPACE + w) for w in words])
        runs = self.runs.findall(SPACE + text.replace(" ", SPACE))
        return sum([self.run[w] if len(w) <= REMEMBERED else self.merged(w) for w in runs])


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row; ``model`` is the path of a
    sentencepiece BPE model, whose bytes are broadcast (bounded by the file).

    Null counts as empty: no bytes, no tokens.  Repeated rows repeat, a null doc_id
    stays null, other columns are ignored, an empty table gives no rows."""
    with open(model, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        counter = Counter(piece_ranks(spec.value))

        def work(b):
            own = b.column(1).to_pylist()
            n = [counter.count(t) for t in own]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in own], pa.int64()), pa.array(n, pa.int64()),
                                               pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

        yield from in_pieces(batches, work)

    return texts(docs).mapInArrow(tidy(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
