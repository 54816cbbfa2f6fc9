"""Byte-pair encoding as a bounded-lookahead streaming transducer, and decoding
with an incremental byte-to-text state machine.

A merge near the end of what has been read can change tokens further left only
through a chain of merges of ever later rank, each touching the token left of
the last one.  ``sufficient_lookahead`` computes from the merge list the longest
stretch of symbols such a chain can cover; a token that ends that far before the
end of the buffer is stable, is emitted, and leaves the buffer.  Merges never
cross an emitted boundary, so the rest goes on alone and the buffer stays within
lookahead plus one block whatever the length of a word."""

from __future__ import annotations

import codecs
import itertools
import json
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from sparkjourney.llm.common import Memo, in_pieces, texts, tidy

BLOCK = 256
#: Longer words go through the transducer without being remembered.
REMEMBERED = 48
DECODED_AT_ONCE = 1 << 15


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte (the byte-level alphabet): printable
    Latin-1 characters stand for themselves, the others for code points from 256."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def _ranges(chars: str) -> str:
    """Ascending characters as ranges of a character class."""
    ranges: list[list[str]] = []
    for c in chars:
        if ranges and ord(c) == ord(ranges[-1][1]) + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"{a}-{b}" for a, b in ranges)


def newer_characters() -> tuple[str, str, str, dict[int, str]]:
    """What the Unicode version of the vocabulary's library says of the code points that
    Python's tables do not assign: its letters and its numbers among them, and those that
    the module ``regex`` takes for either (as ranges), and its lower cases."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    unknown = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cn")
    runs = lambda c: pre_tokenizers.Split(Regex(rf"\p{{{c}}}+"), "removed", invert=True).pre_tokenize_str(unknown)
    letters, numbers = ("".join(t for t, _ in runs(c)) for c in "LN")
    lower = normalizers.Lowercase().normalize_str(unknown)  # one for one: no longer forms are among them
    return _ranges(letters), _ranges(numbers), _ranges("".join(regex.findall(r"[\p{L}\p{N}]+", unknown))), {
        ord(c): low for c, low in zip(unknown, lower, strict=True) if c != low}


def sufficient_lookahead(merges: list[tuple[str, str]], length: dict[str, int]) -> int:
    """Symbols after a token that suffice to know it (see the module's text).

    A merge (u, v) can be caused or prevented by what is right of it if v reaches
    the end of the buffer, or if the token v begins where an earlier such merge
    (s, t) began, so that s is on the left spine of v.  It then reaches |u| further left."""
    left_of: dict[str, str] = {}
    reach: dict[str, int] = {}
    most = 1
    for u, v in merges:
        far, s = length[v], v
        while s is not None:
            far = max(far, reach.get(s, 0))
            s = left_of.get(s)
        far += length[u]
        reach[u] = max(reach.get(u, 0), far)
        left_of.setdefault(u + v, u)
        most = max(most, far)
    return most


class Transducer:
    """Encoder and decoder of one vocabulary file (its bytes)."""

    def __init__(self, spec: bytes, newer: tuple | None = None):
        spec = json.loads(spec)
        model = spec["model"]
        self.ids = model["vocab"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.end = model.get("end_of_word_suffix") or ""
        self.symbols = dict(enumerate(byte_symbols()))
        self.id_bytes = {t: i.to_bytes(4, "little") for t, i in self.ids.items()}
        length = {s: 1 for b in self.symbols.values() for s in (b, b + self.end)}
        for u, v in merges:
            length[u + v] = length[u] + length[v]
        self.lookahead = sufficient_lookahead(merges, length)
        self.length = length
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        own_letters, own_numbers, taken, self.newer_lower = newer_characters() if newer is None else newer
        known = lambda c, own: rf"[[\p{{{c}}}--[{taken}]]{'||[' + own + ']' if own else ''}]" if taken else rf"[\p{{{c}}}{own}]"
        letter, number = known("L", own_letters), known("N", own_numbers)
        self.words = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{number}|[^\p{{White_Space}}{letter}{number}]+")
        self.newer = regex.compile("[" + "".join(map(chr, self.newer_lower)) + "]") if self.newer_lower else None
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.text_of = {i: t.encode("utf-8") for t, i in self.ids.items()} | {i: t.encode("utf-8") for t, i in self.special.items()}
        self.chunk = Memo(self._chunk, 32 << 20)
        self.word = Memo(self._word, 24 << 20)

    def _merge(self, parts: list[str]) -> list[str]:
        """Merges in place: always the lowest rank, leftmost first."""
        get, none = self.rank.get, len(self.rank)
        ranks = [get(p, none) for p in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i] = u = parts[i] + parts[i + 1]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], u), none)
            if i < len(ranks):
                ranks[i] = get((u, parts[i + 1]), none)
        return parts

    def tokens(self, symbols):
        """Tokens of an iterable of symbols of one word, each as soon as it is stable."""
        buffer: list[str] = []
        for s in symbols:
            buffer.append(s)
            if len(buffer) >= self.lookahead + BLOCK:
                left = len(buffer)
                for t in self._merge(buffer.copy()):
                    left -= self.length[t]
                    if left < self.lookahead:
                        left += self.length[t]
                        break
                    yield t
                buffer = buffer[len(buffer) - left:]
        yield from self._merge(buffer)

    def _word(self, word: str) -> bytes:
        symbols = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.symbols)
        # a word shorter than the buffer is the transducer's one flush
        tokens = self._merge([*symbols[:-1], symbols[-1] + self.end]) if len(symbols) < self.lookahead + BLOCK else self.tokens(
            itertools.chain(symbols[:-1], [symbols[-1] + self.end]))
        return b"".join(map(self.id_bytes.__getitem__, tokens))

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha():  # letters only: one word
            return self._word(chunk)
        if chunk[:-1].isalpha() and chunk[-1] in ".,":
            return self.word[chunk[:-1]] + self.word[chunk[-1]]
        return b"".join(self.word[w] if len(w) <= REMEMBERED else self._word(w) for w in self.words.findall(chunk))

    def _plain(self, text: str) -> bytes:
        """Ids of text without special strings: NFC, then each character lower-cased by itself."""
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if self.newer and self.newer.search(text):
            text = text.translate(self.newer_lower)
        if regex.search("[\x1c-\x1f]", text):  # str.split takes these for white space
            chunks = regex.split(r"\p{White_Space}+", text)
        else:
            chunks = text.split()
        return b"".join([self.chunk[c] if len(c) <= REMEMBERED else self._chunk(c) for c in chunks])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; special strings are their own token."""
        if self.cut is None or "<|" not in text:
            return self._plain(text)
        parts = self.cut.split(text)
        return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._plain(p) for p in parts if p)

    def decode(self, ids: bytes) -> str:
        """Text of the ids, made block by block.  The state is the bytes of an
        unfinished character and whether a token came before (tokens are joined by
        one space, as the vocabulary names no decoder)."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        numbers, out = np.frombuffer(ids, "<u4"), []
        for at in range(0, len(numbers), DECODED_AT_ONCE):
            block = b" ".join(map(self.text_of.__getitem__, numbers[at:at + DECODED_AT_ONCE].tolist()))
            out.append(state.decode(b" " + block if at else block))
        out.append(state.decode(b"", True))
        return "".join(out)


def encode_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids, decoded) per row: ids as little-endian unsigned 32-bit
    integers, decoded text.  ``vocabulary`` is the path of a tokenizers file of
    kind BPE with byte symbols; its bytes are broadcast (bounded by the file).

    Null and empty texts give no ids and the empty text; repeated rows repeat;
    null doc_id stays null; other columns are ignored; an empty table gives no rows."""
    with open(vocabulary, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast((f.read(), newer_characters()))

    def run(batches):
        machine = Transducer(*spec.value)

        def work(b):
            ids = [machine.encode(t) for t in b.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array([machine.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

        yield from in_pieces(batches, work)

    return texts(docs).mapInArrow(tidy(run), "doc_id long, ids binary, decoded string")


def token_digests(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``encode_decode``, and the ids."""
    return encode_decode(docs, vocabulary).select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        *(["ids"] if with_ids else []))
