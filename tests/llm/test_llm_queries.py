"""The training-data operators against brute force, libraries and edge inputs."""

import hashlib
import itertools
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from conftest import SMOKE
from sparkjourney.llm import (bpe_stream, common, chat_perspectives, chunk_fingerprint, decontaminate, host_reputation, language_id, ngram_join, queries,
                              secret_grammar, site_templates, token_counts)

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _texts(seed=3, n=300, length=60):
    r = random.Random(seed)
    alphabet = "abcdefghijklmnop  \t\n\x1c\x85\xa0éÉßΣς'strevmld0123456789,.!<|>🙂漢字한́İ▁　①­"
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, length))) for _ in range(n)] + [
        "<|startoftext|>Hi <|endoftext|>", "it's we'll", "a" * 4000 + "Z" * 3000, "", "  ", "the" * 900]


def test_transducer_equals_library():
    from tokenizers import Tokenizer
    machine, library = bpe_stream.Transducer(open(WORD, "rb").read()), Tokenizer.from_file(WORD)
    for text in _texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(machine.encode(text), "<u4").tolist() == ids
        assert machine.decode(machine.encode(text)) == library.decode(ids, skip_special_tokens=False)


def test_every_code_point_is_split_as_in_the_library():
    from tokenizers import Tokenizer
    machine, library = bpe_stream.Transducer(open(WORD, "rb").read()), Tokenizer.from_file(WORD)
    texts = [f"a{chr(c)}b" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x34000 or c % 97 == 0)]
    for k in range(0, len(texts), 20_000):
        for text, want in zip(texts[k:k + 20_000], library.encode_batch(texts[k:k + 20_000], add_special_tokens=False)):
            assert np.frombuffer(machine.encode(text), "<u4").tolist() == want.ids, hex(ord(text[1:-1]))


def test_memos_are_bounded_by_bytes():
    memo = common.Memo(lambda k: k * 50, most=100_000)
    for i in range(20_000):
        assert memo[f"key {i}"] == f"key {i}" * 50
        assert sum(map(len, memo.values())) < 100_000


def test_transducer_emits_stable_tokens_only():
    machine = bpe_stream.Transducer(open(WORD, "rb").read())
    r = random.Random(5)
    for _ in range(5):
        symbols = [r.choice("inthea") for _ in range(4 * machine.lookahead)]
        assert list(machine.tokens(iter(symbols))) == machine._merge(symbols.copy())


def test_token_counts_equal_library():
    import sentencepiece
    counter = token_counts.Counter(token_counts.piece_ranks(open(PIECE, "rb").read()))
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for text in _texts(seed=4):
        assert counter.count(text) == len(library.encode(text))


def _components(rows):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    best = {i: i for i in sets}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while True:
        was = dict(best)
        for a, b in links:
            best[a] = best[b] = min(best[a], best[b])
        if was == best:
            return {i: (len(sets[i]), best[i]) for i in sets}


@pytest.mark.parametrize("leaf", [3, 256])
def test_ngram_join_equals_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(ngram_join, "LEAF", leaf)
    r = random.Random(leaf)
    base = [f"w{r.randrange(9999)}" for _ in range(80)]
    rows = [(0, " ".join(base)), (1, ""), (2, None), (3, "Two Words"), (4, "two  words"), (5, "x")]
    for i in range(6, 36):
        words = list(base)
        for _ in range(r.randrange(6)):
            words[r.randrange(80)] = f"v{r.randrange(9999)}"
        rows.append((i, " ".join(words)))
    for i in range(36, 48):  # a shared passage in documents that are otherwise different
        rows.append((i, " ".join([f"u{r.randrange(10**6)}" for _ in range(60)] + base[:25])))
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == _components(rows)


def test_decontamination_finds_windows(spark):
    r = random.Random(1)
    word = lambda: f"w{r.randrange(5000)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([15, 40, 59, 150])]
    filler = lambda n: " ".join(word() for _ in range(n))
    docs = [(0, filler(300)), (1, None), (2, "")]
    docs += [(10 + i, f"{filler(70)} {t.upper()}  {filler(33)}") for i, t in items]
    near = items[2][1].split()
    near[30] = "changed"
    docs += [(20, f"{filler(9)} {' '.join(near)} {filler(9)}"), (21, " ".join(items[1][1].split()[:20]) + " " + filler(50))]
    got = {(x.doc_id, x.item_id): x for x in decontaminate.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(10, 0), (11, 1), (12, 2), (13, 3), (20, 2)}
    assert got[11, 1].start == 70 and got[11, 1].similarity == 1.0 and 0.8 <= got[20, 2].similarity < 1


def _best_windows(docs, items):
    """{(doc, item): (start, similarity)} by every window of the item's size."""
    grams = lambda t: [tuple(w[k:k + 5]) for w in [t.lower().split()] for k in range(max(1, len(w) - 4))]
    items = {i: grams(t) for i, t in items}
    held = Counter(g for own in items.values() for g in set(own))
    mass = lambda c: sum(n * (1 if held[g] > 1 else 2) for g, n in c.items())
    out = {}
    for d, text in docs:
        for i, own in items.items():
            rows, own = grams(text), Counter(own)
            for a in range(len(rows)):
                window = Counter(rows[a:a + own.total()])
                common = mass(window & own)
                whole = mass(window) + mass(own) - common
                if 100 * common >= 80 * whole and common / whole > out.get((d, i), (0, 0))[1]:
                    out[d, i] = (a, common / whole)
    return out


def test_partial_quotes_of_long_items(spark):
    r = random.Random(8)
    words = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    shared, refrain = words(20), words(7)
    items = [(0, words(65)), (1, words(60) + shared + words(70)), (2, shared + words(30)), (3, words(60) + refrain + words(40) + refrain * 3 + words(90)), (4, words(30) * 5)]
    docs = [(i, words(40) + t + words(25)) for i, t in items]
    docs += [(10 + i, words(30) + t[:len(t) // 2] + words(90)) for i, t in items] + [(20 + i, words(9) + t[-len(t) // 3:]) for i, t in items]
    for k, edits in enumerate([1, 2, 3, 4, 5, 6, 8]):
        for i, t in items:
            t = list(t)
            for at in r.sample(range(len(t)), edits):
                t[at] = "changed"
            docs.append((100 + 10 * k + i, words(11) + t[:50] + words(k % 3) + t[50:] + words(k)))
    docs += [(200, items[3][1][:150] + refrain * 9 + items[3][1][150:]), (201, items[4][1] + items[4][1])]
    docs, items = [(i, " ".join(t)) for i, t in docs], [(i, " ".join(t)) for i, t in items]
    got = {(x.doc_id, x.item_id): (x.start, x.similarity) for x in decontaminate.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == _best_windows(docs, items)
    assert {(i, i) for i in range(5)} <= set(got) and not any(d in (10, 11, 13, 20, 21, 23) for d, _ in got)


def test_edited_fingerprints(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text")
    rows = sorted(((x.doc_id, x.text) for x in docs.collect()), reverse=True)
    got = {x.doc_id: x for x in chunk_fingerprint.edited_fingerprints(docs).collect()}
    chunker = chunk_fingerprint.Chunker()
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        edited = text[:len(text) - len(text) // 3] + after[:len(text) // 3]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].edited_fingerprint == chunk_fingerprint.written(chunker.fingerprint(edited))
    assert np.mean([x.near_edited for x in got.values()]) > 0.5 > 0.1 > np.mean([x.near_next for x in got.values()])


def test_chunks_shift_with_insertions():
    chunker, text = chunk_fingerprint.Chunker(), " ".join(f"word{i * 7919 % 1000}" for i in range(2000))
    a, b = chunker.fingerprint(text), chunker.fingerprint("inserted " + text)
    assert chunk_fingerprint.likeness(a, b) > 0.95 and chunk_fingerprint.likeness(a, a) == 1.0


def test_main_text():
    page = """<html><head><title>t</title><style>p{}</style></head><body><header>Top</header><nav><ul><li>Menu</ul></nav>
    <div class="cookie-notice">Cookies</div><aside>Side</aside><article><h1>A &amp;  B</h1><p>One <b>two</b><br>three<p>Four
    <script>var t="</p>";</script><form><input>Send</form><div class="comments"><p>Nice</p></div></article><div class="ad">Buy</div><footer>End"""
    root = site_templates.parse(page)
    site_templates.hashed(root)
    assert site_templates.main_text(root, frozenset()) == "A & B\nOne two three\nFour"


def test_templates_recur_on_a_host(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div>Same box</div><div><p>Text {i} of its own</p></div></body>") for i in range(8)]
    rows += [(9, None, "<p>alone"), (10, "http://other.example/", None)]
    got = {x.page_id: x.text for x in site_templates.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Text {i} of its own" for i in range(8)} | {9: "alone", 10: ""}


def test_copies_of_a_page_are_no_template(spark):
    copies = {0: ("<article><div><p>First of many</p></div></article>", "First of many"), 1: ("<div><p>Second, without article</p></div>", "Second, without article")}
    rows = [(i, f"http://h.example/{i}", f"<body><script>track({i})</script><div>Same box</div>{copies[i % 4 == 3][0]}</body>") for i in range(40)]
    rows += [(i, f"http://h.example/{i}", f"<body><div>Same box</div><div><p>Text {i}</p></div></body>") for i in range(40, 46)]
    got = {x.page_id: x.text for x in site_templates.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert got == {i: copies[i % 4 == 3][1] for i in range(40)} | {i: f"Text {i}" for i in range(40, 46)}


def test_box_on_a_third_of_a_large_host(spark):
    box = "<div><p>Box of a section</p></div><ul><li><a href='/a'>Menu</a></ul>"
    rows = [(i, f"http://h.example/{i}", f"<body>{box if i % 3 == 0 else ''}<div><p>Text {i}</p><p>{'Yes.' if i % 4 == 0 else ''}</p></div></body>") for i in range(120)]
    got = {x.page_id: x.text for x in site_templates.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert got == {i: f"Text {i}" + ("\nYes." if i % 4 == 0 else "") for i in range(120)}


def test_language_on_held_out_documents(spark):
    rows = queries.op6_language(spark, SMOKE).join(spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [x for x in rows if x.held_out and x.lang]
    assert len(held) > 10 and np.mean([x.lang == x.lang_pred for x in held]) > 0.95
    assert all(0 <= x.score <= 1 for x in rows)


def test_no_letter_is_undetermined(spark):
    texts = ["½ ² ①", "①②", "123 _ -", "", None, "½ straße", "ª"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    learned = language_id.fit(spark.read.parquet(f"{SMOKE}/documents.parquet"))
    got = {x.doc_id: (x.lang_pred, x.score) for x in language_id.identify(docs, learned).collect()}
    assert [got[i] for i in range(5)] == [("und", 0.0)] * 5 and "und" not in (got[5][0], got[6][0])


def test_unlabelled_documents_stay(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    assert language_id.identified(docs, language_id.fit(docs)).count() == docs.count()


def test_wrong_labels_are_corrected(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").where("length(text) > 300")
    true = {x.doc_id: x.lang for x in docs.collect()}
    langs = sorted({v for v in true.values() if v})
    wrong = sorted(x.doc_id for x in docs.where(language_id.held_out() & F.col("lang").isNotNull()).collect())  # no training documents
    other = {i: langs[(langs.index(true[i]) + 1) % len(langs)] for i in wrong}
    rows = [x.asDict() | {"lang": None if x.doc_id == wrong[0] else other.get(x.doc_id, x.lang)} for x in docs.collect()]
    rows.append(rows[0] | {"doc_id": -1, "text": "123 456"})
    df = spark.createDataFrame(rows, docs.schema)
    got = {x.doc_id: x.lang for x in language_id.identified(df, language_id.fit(df)).collect()}
    assert set(got) == set(true) and len(wrong) > 5
    assert np.mean([got[i] == true[i] for i in wrong]) > 0.95


def test_secret_spans():
    key = "AKIA" + "Z9" * 8
    text = f"é token: password: abcdefghijkl1 API_KEY = '{'k' * 12}' {key} {'0f' * 10} token=short"
    spans = secret_grammar.base_spans(text)
    plain = [(m.start(), m.end(), "assign") for m in secret_grammar.ASSIGN.finditer(text) if len(m[2]) >= 12]
    plain += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    plain += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    assert [s[:3] for s in spans] == sorted(plain) and [s[2] for s in spans] == ["assign", "access", "hex"]
    assert key not in secret_grammar.redact(text, [s[:3] for s in spans])


@pytest.mark.parametrize("length,copies", [(20, 1), (4000, 1), (4000, 10)])
def test_long_credentials_are_learned_in_time(length, copies):
    r = random.Random(length)
    base = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(length)) for _ in range(300 // copies)]
    found = sorted({b[:i + 1] + "Z" + b[i + 2:] for b in base for i in range(copies)})
    began = time.process_time()
    automaton = secret_grammar.Automaton(found)
    assert time.process_time() - began < 20
    for state, to in enumerate(automaton.next):  # what leaves a state is never more than what came
        assert sum(automaton._through(state, c) for c in to) <= automaton.seen[state]


def test_grammar_adds_what_fits_a_format_only():
    r = random.Random(2)
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(200)]
    words = ["".join(r.choice(["the", "ing", "or", "an", "st"]) for _ in range(5)) for _ in range(500)]
    grammar = secret_grammar.Grammar({"hex": hexes}, words)
    assert grammar.accepts("0123-4567-89ab-cdef-0123-4567-89ab") or grammar.accepts("9f8e7d6c5b4a39281706")
    assert not grammar.accepts("mail8.example.com") and not grammar.accepts("ingortheanststhe")


def test_every_long_token_is_scored():
    r = random.Random(6)
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    made = lambda n, of=alnum: "".join(r.choice(of) for _ in range(n))
    words = ["".join(r.choice(["the", "ing", "or", "an", "st"]) for _ in range(5)) for _ in range(500)]
    around = lambda n: [made(8) + made(17, "0123456789abcdef") + made(8) for _ in range(n)]
    prefixed = lambda n: [made(5) + "AKIA" + made(16, alnum[26:]) + made(5) for _ in range(n)]
    grammar = secret_grammar.Grammar({"assign": [made(r.randint(12, 30), alnum[:62 - i % 2 * 10]) for i in range(150)] + around(75) + prefixed(75)}, words)
    for tokens in ([made(13) for _ in range(20)], [made(15) for _ in range(20)], [made(18, alnum[:52]) for _ in range(20)], around(20), prefixed(20)):
        learned = 0
        for token in tokens:
            text = f"ingortheanst {token} password: {made(12)} theing"
            spans = secret_grammar.all_spans(text, grammar)
            if (13, 13 + len(token), "learned") in spans:
                learned += 1
                assert secret_grammar.redact(text, spans) == "ingortheanst [LEARNED] [ASSIGN] theing"
        assert learned >= 10


def test_word_model_of_all_documents(spark):
    r = random.Random(7)
    hexed = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    word = lambda parts: "".join(r.choice(parts) for _ in range(3))
    common = [word(["the", "ingen", "orthan", "anster"]) for _ in range(80)]
    rare = [word(["bade", "cafe", "fade", "dec"])[:15] for _ in range(30)]  # like a format, but ordinary in some documents
    key = "faecbdebfcadfbce"[:15]
    rows = [(i, " ".join([*r.sample(common, 12), f"token = '{hexed(32)}'"])) for i in range(400)]
    rows += [(i, " ".join([*r.sample(rare, 20), f"number{i}"])) for i in range(400, 412)] + [(500, f"see {key} here"), (501, f"see {key} here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    grammar = secret_grammar.infer(docs, secret_grammar.scan(docs))
    plain = {w for _, t in rows for w in re.sub("token = '[0-9a-f]+", "", t).split() if re.fullmatch("[A-Za-z.,/_-]{2,}", w)}
    assert grammar.words.pair == secret_grammar.Words(plain).pair
    assert grammar.least >= max(grammar.fit(w) for w in set(common + rare) if len(w) >= 12) + 0.5
    learned = {x.doc_id for x in secret_grammar.find_secrets(docs).collect() if any(s.kind == "learned" for s in x.spans)}
    assert learned <= {500, 501}


def test_url_rules(spark):
    pages = [(1, "http://A.example.com/en/x"), (2, "http://www.example.com/en/x?y"), (3, "https://x.net/fr/1#z"), (4, "https://x.net/de/"),
             (5, None), (6, "no scheme"), (7, "http://com?x")]
    labels = spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in host_reputation.judge(spark.createDataFrame(pages, "page_id long, url string"), labels).collect()}
    assert got[1] == ("a.example.com", "/en/x", "example.com/en/", "block") and got[2] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[3][2:] == ("net/fr/", "block") and got[4][2] is None and got[5][:2] == got[6][:2] == ("", "") and got[7][:3] == ("com", "", None)


def test_bad_host_is_blocked(spark):
    pages = [(i, f"http://{'bad' if i % 2 else 'good'}.example.org/en/{i}") for i in range(400)]
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = host_reputation.judge(spark.createDataFrame(pages, "page_id long, url string"), labels).groupBy("host", "verdict").count().collect()
    assert {(x.host, x.verdict) for x in got} == {("bad.example.org", "block"), ("good.example.org", "allow")}


def test_perspective_masks(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", None), (1, 2, None, "x"), (1, 2, None, "x"), (2, None, "system", "s")]
    got = chat_perspectives.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {x.speaker for x in got} == {"ann", "bob", "unknown"} and all(x.conv_id == 1 for x in got)
    ann = next(x for x in got if x.speaker == "ann")
    assert [ann.rendered[s.start:s.end] for s in ann.spans] == ["hi<|im_end|>\n"]


def test_crowded_conversations_are_cut_every_64_rows(spark):
    rows = [(None, None, "ann", f"null {i % 7}") for i in range(150)] + [(None, 3, "bob", f"tied {i:03}") for i in range(90)] + [(None, 4, "ann", "same")] * 200
    rows += [(1, i, "ann" if i % 2 else "bob", f"t{i}") for i in range(130)] + [(2, 700, "eve", "far")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {(x.conv_id, x.speaker, x.part): x for x in chat_perspectives.perspectives(df).collect()}
    hot = sorted((r for r in rows if r[0] is None), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    want = {(None, s, p): hot[64 * p:64 * p + 64] for s in ("ann", "bob") for p in range(7)}
    want |= {(1, s, p): rows[440 + 64 * p:min(570, 504 + 64 * p)] for s in ("ann", "bob") for p in range(3)} | {(2, "eve", 0): rows[-1:]}
    assert set(got) == set(want)
    for key, part in want.items():
        heads = ["assistant" if r[2] == key[1] else f"user name={r[2]}" for r in part]
        assert got[key].n_turns == len(part) <= 64
        assert got[key].rendered == "".join(f"<|im_start|>{h}\n{r[3]}<|im_end|>\n" for h, r in zip(heads, part))
        assert [got[key].rendered[x.start:x.end] for x in got[key].spans] == [f"{r[3]}<|im_end|>\n" for r in part if r[2] == key[1]]


_OPERATORS = {
    "bpe": lambda d, s: bpe_stream.token_digests(d, WORD), "counts": lambda d, s: token_counts.token_counts(d, PIECE),
    "fingerprints": lambda d, s: chunk_fingerprint.edited_fingerprints(d), "join": lambda d, s: ngram_join.jaccard_components(d),
    "secrets": lambda d, s: secret_grammar.span_digests(secret_grammar.find_secrets(d)),
    "language": lambda d, s: language_id.identify(d, language_id.fit(d)),
    "decontaminate": lambda d, s: decontaminate.contaminated(d, s.createDataFrame([(1, "a b c d e f"), (2, None)], "item_id long, text string")),
}


@pytest.mark.parametrize("name", sorted(_OPERATORS))
def test_edge_inputs(spark, name):
    """Nulls in any column, empty and long texts, repeated rows, clashing columns, an empty table."""
    rows = [(1, "a b c d e f", "en", None, None), (1, "a b c d e f", "en", None, None), (2, None, None, None, 1), (None, "", "fr", "x", 0),
            (3, "wörd " * 30_000, "de", "y", 5)]
    df = spark.createDataFrame(rows, DOCS)
    clash = df.selectExpr("*", "1 AS n_tokens", "2 AS n", "3 AS spans", "'x' AS fingerprint", "4 AS component_id", "5 AS key", "6 AS score")
    n = _OPERATORS[name](clash, spark).count()
    assert n == (1 if name == "decontaminate" else len(rows))
    assert _OPERATORS[name](df.limit(0), spark).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql_oracle(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "pages", "labels", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SMOKE)
    cur = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE[name]})")
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, cur.fetchall()))


def test_stages_are_read_back_from_parquet(spark, monkeypatch):
    import corpus_pipeline
    seen = []
    stage = lambda spark, docs, sf_dir: (seen.append(docs.inputFiles()), docs.withColumn("source", F.lit("x")))[1]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", stage), ("b", stage), ("c", stage)])
    got = corpus_pipeline.run(spark, SMOKE)
    top = spark.sparkContext.getCheckpointDir()
    assert all(f.endswith(".parquet") for files in seen for f in files) and all(files for files in seen)
    assert [{f.split("/")[-2] for f in files} for files in seen[1:]] == [{"a"}, {"b"}]
    assert all(f.split(":")[-1].lstrip("/").startswith(top.split(":")[-1].lstrip("/")) for files in seen[1:] for f in files)
    assert got.count() == spark.read.parquet(f"{SMOKE}/documents.parquet").count()


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    rows = sorted(((x.doc_id, x.text) for x in docs.collect()))
    items = [x.text.lower().split() for x in spark.read.parquet(f"{SMOKE}/benchmark.parquet").collect()]
    comp = _components([(i, t) for i, t in rows if any(c.isalpha() for c in t)])
    whole = lambda t: " " + " ".join(t.lower().split()) + " "
    want = {i: t for i, t in rows if i in comp and comp[i][1] == i and not any(whole(" ".join(w)) in whole(t) for w in items)}
    got = corpus_pipeline.run(spark, SMOKE).collect()
    assert {x.doc_id for x in got} == set(want)
    machine = bpe_stream.Transducer(open(WORD, "rb").read())
    clean = {i for i, t in want.items() if not secret_grammar.base_spans(t)}
    same = [x for x in got if x.doc_id in clean and bytes(x.ids) == machine.encode(want[x.doc_id])]
    assert len(clean) > 100 and len(same) >= len(clean) - 1


ARTICLE = "<p>" + "Words of a long paragraph that nobody would take for a menu. " * 6 + "</p>"


@pytest.mark.parametrize("page", [
    f'<article class="post-with-sidebar">{ARTICLE}</article>', f'<div class="with-sidebar">{ARTICLE}</div>', f'<div class="sidebar"><article>{ARTICLE}</article></div>',
    f'<form id="aspnetForm"><article>{ARTICLE}</article></form>', f'<article><section class="related-work">{ARTICLE}</section></article>',
    f'<article><div class="share-price">{ARTICLE}</div></article>', f'<article><div id="menu-of-the-day">{ARTICLE}</div></article>', f'<div class="content main page-header">{ARTICLE}</div>'])
def test_names_do_not_delete_articles(page):
    root = site_templates.parse(f"<html><body><div class='top-menu'><a href='/'>Home</a></div>{page}<div class='cookie-notice'>We use cookies</div></body></html>")
    site_templates.hashed(root)
    assert site_templates.main_text(root, frozenset()) == " ".join(("Words of a long paragraph that nobody would take for a menu. " * 6).split())


@pytest.mark.parametrize("box", ['<div class="comments">{0}</div>', '<div id="sidebar-left">{0}</div>', '<section class="related-posts">{0}</section>', '<div class="ad-box">{0}</div>',
                                 '<div class="share-price"><a href="/x">Buy now</a></div>', '<div role="navigation">{0}</div>', '<div hidden>{0}</div>'])
def test_named_boxes_go(box):
    root = site_templates.parse(f"<body><article>{ARTICLE}{box.format('<p>Some of the box.</p>')}{ARTICLE}</article></body>")
    site_templates.hashed(root)
    assert "box" not in site_templates.main_text(root, frozenset()) and "Buy" not in site_templates.main_text(root, frozenset())


@pytest.mark.parametrize("source", ["<a " * 350_000, "<a href='" * 120_000, "<!" * 500_000, "<b></i>" * 150_000, "<b>" * 300_000, "<li>" * 250_000, "<p><b>" * 170_000,
                                    "<" * 1_000_000, '<a title="x>' * 90_000 + ">", "<script>" * 120_000, "<b>" * 150_000 + "<p>" * 150_000, "&amp" * 250_000])
def test_a_megabyte_of_broken_markup_is_parsed_in_time(source):
    began = time.process_time()
    root = site_templates.parse(source)
    site_templates.hashed(root)
    site_templates.main_text(root, frozenset())
    assert time.process_time() - began < 15


def test_parse_of_odd_markup():
    def outline(node):
        return [outline(c) if isinstance(c, site_templates.Node) else c for c in node.children] if node.children else node.tag
    flat = lambda s: "".join(x if isinstance(x, str) else "" for x in _strings(site_templates.parse(s)))

    def _strings(node):
        for c in node.children:
            yield from (_strings(c) if isinstance(c, site_templates.Node) else [c])
    assert flat("a < b <p>c</p> 1<2 <") == "a < b c 1<2 <"
    assert flat("<p title='a>b'>c</p>") == "c" and flat('<p title="a>b') == '<p title="a>b'.split(">")[1]
    assert flat("<!-- <p> -->x<!-- open") == "x" and flat("<!DOCTYPE html>y<?php z?>") == "y"
    assert flat("<script>if (a < b) {}</script>t<script>open") == "if (a < b) {}topen"
    assert outline(site_templates.parse("<p>a<p>b<ul><li>c<li>d</ul>")) == [["a"], ["b"], [["c"], ["d"]]]


@pytest.mark.parametrize("limit", [0, 1 << 24])
def test_html_joins_its_template_either_way(spark, monkeypatch, limit):
    monkeypatch.setattr(site_templates, "BROADCAST_BYTES", limit)
    rows = [(i, f"http://h{0 if i % 3 else i % 40}.example/{i}", f"<body><div>Same box</div><div><p>Text {i} of its own</p></div></body>") for i in range(240)]
    rows += [(900, None, "<p>alone"), (901, "http://x/", None)]
    got = site_templates.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert len(got) == len(rows) and {x.page_id: x.text for x in got if x.page_id < 900 and x.page_id % 3} == {i: f"Text {i} of its own" for i in range(240) if i % 3}


def test_crowded_conversations_equal_sql(spark):
    r = random.Random(9)
    rows = [(1, 5, r.choice("abc"), f"t{r.randrange(30)}") for _ in range(65)] + [(2, None, "a", f"n{i}") for i in range(130)] + [(2, 3, "b", None)] * 70
    rows += [(3, i, r.choice(["system", "a", "b"]), f"x{i}") for i in range(200)] + [(None, 1, None, "y"), (4, 1, "system", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_perspectives.with_written_spans(chat_perspectives.perspectives(df))
    db = duckdb.connect()
    db.register("conversations", df.toArrow())
    want = db.sql(chat_perspectives.perspectives_sql()).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(x)) for x in got.collect()) and {x[2] for x in want} == {0, 1, 2, 3}


_PAGES = "page_id long, url string, html string"
_EDGES = {
    "pages": (lambda d, s: site_templates.main_texts(d), _PAGES, "1 AS host, 'x' AS template, 2 AS text, 3 AS n_chars, 4 AS page, 5 AS hashes"),
    "urls": (lambda d, s: host_reputation.judge(d, s.createDataFrame([(1, 1, 0), (None, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int")), _PAGES,
             "1 AS host, 2 AS rule, 3 AS verdict, 4 AS n, 5 AS doc_id, 6 AS quality"),
    "turns": (lambda d, s: chat_perspectives.perspectives(d), "conv_id long, turn long, role string, text string", "1 AS part, 2 AS turns, 3 AS speaker, 4 AS copies, 5 AS spans"),
}


@pytest.mark.parametrize("name", sorted(_EDGES))
def test_edge_inputs_of_pages_and_turns(spark, name):
    """Nulls in any column, empty and long values, repeated rows, clashing columns, an empty table."""
    work, schema, clash = _EDGES[name]
    if name == "turns":
        rows = [(1, 1, "a", "x"), (1, 1, "a", "x"), (None, None, None, None), (2, None, "b", ""), (2, 5, None, "long " * 50_000)]
        n = 4  # a; unknown; b and unknown
    else:
        rows = [(1, "http://a.example/en/1", "<p>x</p>"), (1, "http://a.example/en/1", "<p>x</p>"), (None, None, None), (2, "", ""),
                (3, "http://" + "h" * 10_000 + "/" + "p" * 100_000, "<div>" * 20_000 + "word " * 100_000)]
        n = len(rows)
    df = spark.createDataFrame(rows, schema)
    assert work(df.selectExpr("*", *clash.split(", ")), spark).count() == n
    assert work(df.limit(0), spark).count() == 0


def test_pipeline_keeps_only_the_last_stage(spark, tmp_path):
    import os
    import corpus_pipeline
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    was = {x for x in os.listdir(folder) if x.startswith("pipeline-")}
    corpus_pipeline.run(spark, SMOKE)
    new = [x for x in os.listdir(folder) if x.startswith("pipeline-") and x not in was]
    assert len(new) == 1 and os.listdir(f"{folder}/{new[0]}") == ["secrets"]


def _chunks(text):
    """Chunks of a text by the definition: a hash of the last 32 bytes at every byte, one after the other."""
    data = text.encode()
    gear = [int(x) >> 32 for x in chunk_fingerprint._mixed(512)[:256]]
    small, normal, large = chunk_fingerprint.SMALLEST, chunk_fingerprint.NORMAL, chunk_fingerprint.LARGEST
    out, start, h = [], 0, 0
    for i, b in enumerate(data):
        h = ((h << 1) + gear[b]) & 0xFFFFFFFF
        size = i + 1 - start
        bits = chunk_fingerprint.STRICT_BITS if size <= normal else chunk_fingerprint.LOOSE_BITS
        loose = size >= normal and h >> (32 - chunk_fingerprint.LOOSE_BITS) == 0
        if len(data) - start > small and (size >= small and h >> (32 - bits) == 0 or loose or size == large):
            out.append(data[start:i + 1])
            start = i + 1
    return out + ([data[start:]] if start < len(data) else [])


def _like(a, b):
    a, b = set(a), set(b)
    return sum(map(len, a & b)) / sum(map(len, a)) if a else float(not b)


def _near_rows(rows):
    rows = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0)))
    out = {}
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        edited = text[:len(text) - len(text) // 3] + after[:len(text) // 3]
        own, changed = _chunks(text), _chunks(edited)
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), _like(own, changed), _like(own, _chunks(after)), sorted(map(len, set(own))), sorted(map(len, set(changed))))
    return out


def test_likeness_by_plain_chunks(spark):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{SMOKE}/documents.parquet").where("length(text) < 3000").limit(80).collect()]
    rows += [(10**7 + i, rows[i][1]) for i in range(20)] + [(10**8, ""), (10**8 + 1, "é" * 500), (None, "the last one " * 40)]
    want = _near_rows(rows)
    lengths = lambda f: sorted(int(f[k + 12:k + 14], 16) + 1 for k in range(0, len(f), 14))
    for x in chunk_fingerprint.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect():
        n, sha, edited, following, own, changed = want[x.doc_id]
        assert (x.n_chars, x.edited_sha256, lengths(x.fingerprint), lengths(x.edited_fingerprint)) == (n, sha, own, changed)
        assert abs(x.near_edited - edited) < 1e-12 and abs(x.near_next - following) < 1e-12


@pytest.mark.parametrize("hot", [None, 50])
def test_an_id_with_most_rows_is_cut(spark, hot):
    rows = [(i, f"text {i} " * 20) for i in range(100)] + [(hot, f"hot {i} " * 20) for i in range(400)]
    dealt = chunk_fingerprint.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    sizes = Counter(x["range"] for x in dealt)
    assert max(sizes.values()) < 120 and sum(not x.guest for x in dealt) == 500
    assert sum(x.guest for x in dealt) == len({x["range"] for x in dealt})
    got = chunk_fingerprint.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # every row once, each edited with the head of the next one
    texts_ = [x.text for x in sorted((x for x in dealt if not x.guest), key=lambda x: (-x.order, x.h))]
    edited = [hashlib.sha256((t[:len(t) - len(t) // 3] + u[:len(t) // 3]).encode()).hexdigest() for t, u in zip(texts_, texts_[1:] + texts_[:1])]
    assert sorted(x.edited_sha256 for x in got) == sorted(edited)
