"""Secret scans with inferred grammars.

Three fixed patterns find the base credentials.  The credentials of each pattern
label a bounded sample, from which a probabilistic automaton is inferred: a
prefix tree whose states are merged, breadth first, wherever a Hoeffding bound
finds their outgoing and ending frequencies compatible.  All other tokens
as long as the shortest credential that a pattern takes, also around a base span,
are then scored by their likelihood under the automata against a character model
of the corpus' words, and what fits a format better than the
words, at least as well as all but the worst labelled ones, adds ``learned`` spans."""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sparkjourney.llm.common import Memo, by_batch, cut, shipped, texts, tidy

#: Bound of the labelled sample, credentials a kind.
PER_KIND = 300
#: Characters of a credential that the automata are learned from.
FIT_CHARS = 96
#: The base kinds, in the order of the result, their patterns, and the kind the method adds.
KINDS = ("assign", "access", "hex", "learned")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # of 18 characters or more
HEX = re.compile(r"[0-9a-f]{16,}")
#: Length of the shortest credential that a base pattern takes, and so of a candidate.
SHORTEST = 12
TOKEN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{SHORTEST},}}")
WORD = re.compile(r"[A-Za-z.,/_-]{2,}")
ALPHABET = 66


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, secret) of the base patterns, leftmost non-overlapping per kind."""
    found = [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= SHORTEST] if "=" in text or ":" in text else []
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, base) -> list[tuple[int, int, str]]:
    """Whole tokens of SHORTEST characters or more, but those that base spans cover."""
    out = []
    for m in TOKEN.finditer(text):
        token, start = m[0].rstrip(".=-"), m.start()
        if len(token) >= SHORTEST:
            at, end = start, start + len(token)
            for s, e, *_ in base:
                if s <= at < e:
                    at = e
            if at < end:
                out.append((start, end, token))
    return out


class Automaton:
    """Deterministic probabilistic automaton inferred from strings.

    It is learned from the first ``most`` characters of each (a cut string has no end
    there), so the sample's size bounds the tree; what is scored is never cut."""

    def __init__(self, strings: list[str], alpha: float = 0.05, most: int = FIT_CHARS):
        self.seen, self.ends, self.next, self.passed = [0], [0], [{}], Counter()
        for s in strings:
            at = 0
            self.seen[0] += 1
            for c in s[:most]:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.seen)
                    self.seen.append(0)
                    self.ends.append(0)
                    self.next.append({})
                self.seen[to] += 1
                self.passed[at, c] += 1
                at = to
            self.ends[at] += len(s) <= most
        self.bound = math.sqrt(0.5 * math.log(2.0 / alpha))
        # kept states and their order; what a transition of a kept state leads to waits for its turn
        kept, waiting = {0: 0}, [(0, c) for c in sorted(self.next[0])]
        order = [0]
        while waiting:
            place, c = heapq.heappop(waiting)
            state = self.next[order[place]][c]
            if state in kept:
                continue
            same = next((r for r in order if self._compatible(r, state)), None)
            if same is None:
                kept[state] = len(order)
                order.append(state)
                for x in self.next[state]:
                    heapq.heappush(waiting, (kept[state], x))
            else:
                self.next[order[place]][c] = same
                for r, x in self._fold(same, state):
                    if r in kept:
                        heapq.heappush(waiting, (kept[r], x))

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the frequencies of a and b agree, and those below b with what a leads to."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = self.seen[a], self.seen[b]
            if nb <= self.bound ** 2:  # too few strings, here and below, to differ from anything
                continue
            if self._differ(self.ends[a], na, self.ends[b], nb):
                return False
            for c in {*self.next[a], *self.next[b]}:
                x, y = self.next[a].get(c), self.next[b].get(c)
                if self._differ(self._through(a, c), na, self._through(b, c), nb):
                    return False
                if x is not None and y is not None and x != y:
                    todo.append((x, y))
        return True

    def _through(self, state: int, c: str) -> int:
        """Strings that took a transition."""
        return self.passed.get((state, c), 0)

    def _fold(self, into: int, tree: int) -> list[tuple[int, str]]:
        """Adds the subtree's counts to the state it was merged with; gives the new transitions."""
        todo, new = [(into, tree)], []
        while todo:
            a, b = todo.pop()
            self.seen[a] += self.seen[b]
            self.ends[a] += self.ends[b]
            for c, y in self.next[b].items():
                x = self.next[a].get(c)
                self.passed[a, c] += self.passed[b, c]
                if x is None:
                    self.next[a][c] = y
                    new.append((a, c))
                else:
                    todo.append((x, y))
        return new

    def score(self, text: str) -> float:
        """Log likelihood of the text's characters; a character never seen in a state
        has a smoothed chance and stays in that state."""
        total, at = 0.0, 0
        for c in text:
            n = self.seen[at]
            total += math.log((self._through(at, c) + 0.01) / (n + 0.01 * ALPHABET))
            at = self.next[at].get(c, at)
        return total


class Words:
    """Character pairs of ordinary words."""

    def __init__(self, strings):
        self.pair, self.single = Counter(), Counter()
        for s in strings:
            s = " " + s
            self.pair.update(zip(s, s[1:]))
            self.single.update(s[:-1])

    @classmethod
    def counted(cls, pairs) -> Words:
        """From (first, second, number) of character pairs."""
        words = cls(())
        for a, b, n in pairs:
            words.pair[a, b] += n
            words.single[a] += n
        return words

    def score(self, text: str) -> float:
        text = " " + text
        return sum(math.log((self.pair[a, b] + 0.1) / (self.single[a] + 0.1 * ALPHABET)) for a, b in zip(text, text[1:]))


class Grammar:
    """Automata by kind, the word model, and the least score of a learned span."""

    def __init__(self, labelled: dict[str, list[str]], words: list[str] | Words):
        self.words = words if isinstance(words, Words) else Words(words)
        self.automata = {k: Automaton(sorted(v)) for k, v in sorted(labelled.items()) if v}
        own = [self.fit(s) for v in labelled.values() for s in v]
        #: as good as 95 % of the labelled credentials, and above all ordinary words
        self.least = max(np.quantile(own, 0.05), 0.5) if own else math.inf
        if own and not isinstance(words, Words):
            self.above(max((self.fit(w) for w in words if len(w) >= SHORTEST), default=0.0))

    def above(self, best: float) -> None:
        """Raises the least score above ``best``, that of the best ordinary word."""
        self.least = max(self.least, best + 0.5)

    def fit(self, text: str) -> float:
        """Log-likelihood ratio a character of the best format against the words."""
        return (max(a.score(text) for a in self.automata.values()) - self.words.score(text)) / max(1, len(text))

    @cached_property
    def _known(self) -> Memo:
        return Memo(lambda text: self.fit(text) >= self.least)

    def accepts(self, text: str) -> bool:
        return bool(self.automata) and self._known[text]


_FOUND = ("doc_id long, base array<struct<start:long,end:long,kind:string,secret:string>>, "
          "open array<struct<start:long,end:long,secret:string>>")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, open): base spans and unlabelled candidates of each whole text."""
    def run(batches):
        for b in batches:
            base = [base_spans(t) for t in b["text"]]
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "base": [[dict(zip(("start", "end", "kind", "secret"), s)) for s in x] for x in base],
                "open": [[dict(zip(("start", "end", "secret"), s)) for s in candidates(t, x)] for t, x in zip(b["text"], base)]})

    return texts(docs).mapInPandas(tidy(run), _FOUND)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, ordinary): the distinct words of all texts outside base spans; a word is
    ordinary if texts that differ hold it, as a credential stands in one text and its copies."""
    def run(batches):
        for b in batches:
            held = {}
            for t in b.column("text").to_pylist():
                at, rest, body = 0, [], xxhash.xxh64(t.encode("utf-8", "surrogatepass")).intdigest() - (1 << 63)
                for start, end, *_ in base_spans(t):
                    rest.append(t[at:start])
                    at = max(at, end)
                for w in set(" ".join([*rest, t[at:]]).split()):
                    low, high = held.get(w, (body, body))
                    held[w] = min(low, body), max(high, body)
            found = [(w, *v) for w, v in held.items() if WORD.fullmatch(w)]
            yield pa.RecordBatch.from_pylist([dict(zip(("word", "low", "high"), f)) for f in found], schema)

    schema = pa.schema([("word", pa.string()), ("low", pa.int64()), ("high", pa.int64())])
    return (texts(docs).mapInArrow(tidy(run), "word string, low long, high long")
            .groupBy("word").agg((F.min("low") < F.max("high")).alias("ordinary")))


def infer(docs: DataFrame, found: DataFrame, per_kind: int = PER_KIND) -> Grammar:
    """Grammar from at most ``per_kind`` distinct credentials a kind and the words of all documents."""
    secrets = found.select(F.explode("base").alias("s")).select("s.kind", "s.secret")
    labelled = {k: [r[0] for r in secrets.where(F.col("kind") == k).groupBy("secret").count()
                    .orderBy(F.xxhash64("secret"), "secret").limit(per_kind).select("secret").collect()] for k in KINDS[:3]}
    words = cut(vocabulary(docs))

    def pairs(batches):
        for b in batches:
            seen = Words(b.column("word").to_pylist()).pair
            yield pa.RecordBatch.from_pydict({"a": [k[0] for k in seen], "b": [k[1] for k in seen], "n": list(seen.values())}, schema)

    schema = pa.schema([("a", pa.string()), ("b", pa.string()), ("n", pa.int64())])
    # one row a pair of the words' characters
    counted = words.mapInArrow(tidy(pairs), "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    grammar = Grammar(labelled, Words.counted(counted))
    if grammar.automata:
        load = shipped(docs.sparkSession, grammar)

        def best(batches):
            model = load()
            for b in batches:
                fits = [model.fit(token) for w in b["word"] for *_, token in candidates(w, ())]
                yield pd.DataFrame({"fit": [max(fits)] if fits else []}, dtype="float64")

        top = words.where("ordinary").mapInPandas(tidy(best), "fit double").agg(F.max("fit")).first()[0]
        grammar.above(0.0 if top is None else top)
    return grammar


def find_secrets(docs: DataFrame, per_kind: int = PER_KIND) -> DataFrame:
    """(doc_id, spans): array of (start, end, kind) in code points by start, then kind;
    the base spans and the learned ones.  Null counts as empty and has none; repeated
    rows repeat, a null doc_id stays null, an empty table gives no rows, other columns are ignored."""
    found = cut(scan(docs))
    load = shipped(docs.sparkSession, infer(docs, found, per_kind))

    def label(batches):
        grammar = load()
        for b in batches:
            out = []
            for base, more in zip(b["base"], b["open"]):
                spans = [(s["start"], s["end"], s["kind"]) for s in base]
                spans += [(s["start"], s["end"], "learned") for s in more if grammar.accepts(s["secret"])]
                out.append([dict(zip(("start", "end", "kind"), s)) for s in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))])
            yield pd.DataFrame({"doc_id": b["doc_id"], "spans": out})

    return found.mapInPandas(tidy(label), "doc_id long, spans array<struct<start:long,end:long,kind:string>>")


def span_digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of ``find_secrets``."""
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "learned")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(text: str, spans) -> str:
    """The text with each run of overlapping spans replaced by the mark of its first kind."""
    out, at = [], 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def all_spans(text: str, grammar: Grammar) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base and the learned spans of one text."""
    base = base_spans(text)
    return [s[:3] for s in base] + [(a, b, "learned") for a, b, token in candidates(text, base) if grammar.accepts(token)]


def redacted(docs: DataFrame, per_kind: int = PER_KIND) -> DataFrame:
    """``docs`` with every secret replaced by a mark of its kind, and n_chars to match; all columns."""
    load = shipped(docs.sparkSession, infer(docs, cut(scan(docs).select("base")), per_kind))

    def change():
        grammar = load()

        def step(batch, texts):
            spans = [all_spans(t or "", grammar) for t in texts]
            if not any(spans):
                return batch
            new = [redact(t, s) if s else t for t, s in zip(texts, spans)]
            at, n = batch.schema.get_field_index("text"), batch.schema.get_field_index("n_chars")
            batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            if n >= 0:
                size = [len(t) if s else v for t, s, v in zip(new, spans, batch.column(n).to_pylist())]
                batch = batch.set_column(n, batch.schema.field(n), pa.array(size, batch.schema.field(n).type))
            return batch

        return step

    return by_batch(docs, change)
