"""SentencePiece codec, conversation trie and divergence audit against the library, brute force and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from hazeline.llm import conversation_trie, divergence, piece_codec, pieces
from tests.llm.test_llm import EDGE, rows, table

MODEL = P.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
SIGNS = st.lists(st.sampled_from([*"abeinrt  ▁▁\n\t\x00<s>/0x1é漢字\U0001f600\u200d\ufffd", "the", " in", "<0x0A>", "</s>"]), max_size=40).map("".join)

# --- SentencePiece


@settings(max_examples=300, deadline=None)
@given(st.one_of(SIGNS, st.text(max_size=40)))
def test_pieces_agree_with_the_library(text):
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    model = pieces.model(MODEL)
    ids, offsets = model.encode_batch([text, "", text])
    want = LIBRARY.encode(text)
    assert ids.tolist() == want + want and offsets.tolist() == [0, len(want), len(want), 2 * len(want)]
    assert model.decode(want + [model.end]) == LIBRARY.decode(want + [model.end])


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2), st.integers(3, 258), st.sampled_from([259, 260, 3 + 0xE4, 3 + 0xB8, 3 + 0x80, 3 + 0xEF, 3 + 0xBF]), st.integers(259, 31_999)), max_size=9))
def test_decoding_any_ids(ids):
    assert pieces.model(MODEL).decode(ids) == LIBRARY.decode(ids)


def test_long_segments():
    rnd = random.Random(1)
    model = pieces.model(MODEL)
    for text in ("".join(rnd.choice("abcdefgh") for _ in range(50_000)), " " * 20_001, "aaaa" * 5_000, "\U0001f600" * 999):
        assert model.encode_batch([text])[0].tolist() == LIBRARY.encode(text)


def test_memos_that_overflow(monkeypatch):
    rnd = random.Random(2)
    monkeypatch.setattr(pieces, "MEMO", 3)
    monkeypatch.setattr(pieces, "PAIRS_KEPT", 2)
    with open(MODEL, "rb") as f:
        model = pieces.PieceModel(f.read())
    for _ in range(20):
        text = " ".join("".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(1, 8))) for _ in range(9))
        assert model.encode_batch([text])[0].tolist() == LIBRARY.encode(text)


def test_piece_codec(spark):
    docs = table(spark, [*EDGE, (8, "long " * 500_000, "d"), (9, "<s> </s> <unk>", "d")])
    got = piece_codec.round_trip(docs, MODEL)
    want = []
    for i, t, _ in [*EDGE, (8, "long " * 500_000, ""), (9, "<s> </s> <unk>", "")]:
        ids = LIBRARY.encode(t or "") + [2]
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()))
    assert rows(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
    back = piece_codec.decode(piece_codec.encode(docs, MODEL), MODEL)
    assert rows(back, "doc_id", "text") == sorted(((i, t or "") for i, t, _ in [*EDGE, (8, "long " * 500_000, ""), (9, "<s> </s> <unk>", "")]), key=str)
    assert piece_codec.round_trip(table(spark, []), MODEL).count() == 0


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.PieceModel(b"")


# --- conversation trie

TURNS = "conv_id long, turn long, role string, text string, key string, depth string"
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute_trie(turns):
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(own.get(c - c % 5, [])[:h] + mine[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    kids = Counter(s[:-1] for s in members if s)
    leaves, saved = Counter(), Counter()
    for s, m in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += not kids[s]
            saved[s[:d]] += (len(m) - 1) * len(s[-1][1].encode()) if s else 0
    digest = lambda s: hashlib.sha256(",".join(map(str, sorted(ends[s]))).encode()).hexdigest()
    return sorted(((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), kids[s], leaves[s], saved[s], digest(s)) for s, m in members.items()), key=str)


def turns_table(spark, turns):
    return spark.createDataFrame([(*t, "k", "d") for t in turns], TURNS)


def random_turns(seed, convs):
    rnd = random.Random(seed)
    said = [(r, t) for r in ("user", None, "") for t in ("", None, "aé", "b", "x" * 50)]
    turns = [(c, k if rnd.random() < 0.9 else rnd.choice([None, k - 1]), *rnd.choice(said[: rnd.choice([2, 4, 15])])) for c in range(convs) if c % 7 for k in range(rnd.choice([1, 2, 3, 9, 14]))]
    return turns + turns[:5] + [(None, 0, "user", "lost")] + [(3, k, "user", "of the largest") for k in range(len(turns) // 2)]


@pytest.mark.parametrize(("segment", "run"), [(4096, 32_768), (1, 4), (3, 3), (2, 7)])
def test_conversation_trie(spark, monkeypatch, segment, run):
    monkeypatch.setattr(conversation_trie, "RUN", run)
    monkeypatch.setattr(conversation_trie, "IDS", run)
    monkeypatch.setattr(conversation_trie, "TURNS", 4)
    turns = random_turns(segment, 40)
    if segment < 4096:
        turns = [t for t in turns if t[3] != "of the largest" or t[1] < 8]
    assert rows(conversation_trie.trie(turns_table(spark, turns), segment), *NODE) == brute_trie(turns)


def test_copies_of_a_conversation(spark, monkeypatch):
    """A third of all conversations equal one another, some end inside others, some have no turns left."""
    monkeypatch.setattr(conversation_trie, "IDS", 16)
    turns = [(5 * c, k, "user", "copied" if c % 3 == 0 else f"{c} {k}") for c in range(90) for k in range(1 + c % 4)] + [(5 * c + 1, 0, "user", "one") for c in range(100, 130)]
    assert rows(conversation_trie.trie(turns_table(spark, turns)), *NODE) == brute_trie(turns)


def test_empty_conversations(spark):
    assert conversation_trie.trie(turns_table(spark, [])).count() == 0
    lost = [(1, None, None, None)] * 3 + [(2, 0, "user", "x")]  # conversations without a base lose their first turns
    assert rows(conversation_trie.trie(turns_table(spark, lost)), *NODE) == brute_trie(lost)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.lists(st.integers(0, 2), max_size=6), max_size=8), max_size=7))
def test_loser_tree(runs):
    name = lambda s: b"".join(bytes([x]) * conversation_trie.NAME for x in s)
    made = [conversation_trie.sorted_run([(name(s),) for s in r]) for r in runs]
    merged = list(conversation_trie.LoserTree([zip(r, shared, strict=False) for r, shared in made]))
    keys = [row[0] for row, _ in merged]
    assert keys == sorted(k for r, _ in made for (k,) in r)
    assert [s for _, s in merged][1:] == [conversation_trie.lcp(a, b, 0) for a, b in zip(keys, keys[1:], strict=False)]


def test_shared_turns_are_not_compared_again(monkeypatch):
    """Merging strings with a long common start looks at it at most once for each run."""
    looked = []
    plain = conversation_trie.lcp
    start = [7] * 500
    made = [conversation_trie.sorted_run([(bytes(16 * [0]) + b"".join(bytes([x]) * 16 for x in [*start, a, b]),) for a in range(k, 40, 4)]) for k in range(4) for b in (k,)]
    monkeypatch.setattr(conversation_trie, "lcp", lambda a, b, known: looked.append(plain(a, b, known) - known) or known + looked[-1])
    assert len(list(conversation_trie.LoserTree([zip(r, s, strict=True) for r, s in made]))) == 40
    assert sum(x > 400 for x in looked) <= 4


# --- divergence audit

AUDIT = ("lang", "source", "part", "item", "value", "rank")
DOC = "doc_id long, text string, lang string, source string, term string, n long, value string"


def brute_audit(docs, least, top):
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        counts[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in seen[lang].items() if n >= least]
        names = sorted(s for x, s in groups if x == lang)
        rate = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p = {s: rate(counts[lang, s]) for s in names}
        q = rate(sum((counts[lang, s] for s in names), Counter()))
        for s in names:
            ranked = sorted(((sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in names if o != s), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "pair", o, v, k + 1) for k, (v, o) in enumerate(ranked)]
            best = sorted(((p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "term", t, v, k + 1) for k, (v, t) in enumerate(best[:top])]
    return sorted(out, key=str)


def counters(trie):
    found = trie.summed().T.tolist()
    return [(term, {g: (n, d) for t, g, n, d in found if t == leaf}) for term, leaf in trie.walk()]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abé", max_size=5), st.integers(0, 2)), max_size=40))
def test_radix_trie(added):
    trie, want = divergence.RadixTrie(), defaultdict(dict)
    for term, group in added:
        trie.count(*(np.array([x]) for x in (trie.leaf(term.encode()), group, 2, 1)))
        n, d = want[term.encode()].get(group, (0, 0))
        want[term.encode()][group] = n + 2, d + 1
    assert counters(trie) == sorted(want.items()) and trie.leaves == len(want)


def some_docs(seed):
    rnd = random.Random(seed)
    words = ["Word", "word", "été", "ÉTÉ", "don't", "漢字", "\U0001f600", "a", "B", "x1y", "\xa0", "zz", "￿", "𐀀", *(f"w{chr(97 + k)}" for k in range(20))]
    docs = [(" ".join(rnd.choices(words[: rnd.choice([5, 20, 34])], k=rnd.randint(0, 30))), rnd.choice(["en", "fr", None, ""]), rnd.choice(["a", "b", "é", None, "hot", "hot"])) for _ in range(150)]
    return docs + docs[:9] + [(None, "en", "none"), ("", "de", "alone"), ("1 2 3", "fr", None), ("word " * 3_000, "en", "hot"), ("q" * 100_000, "fr", "a")]


@pytest.mark.parametrize(("least", "tile", "slice_", "leaves", "chunk"), [(3, 256, 100_000, 200_000, 1 << 21), (2, 1, 7, 5, 100), (1, 2, 50, 1, 1), (10_000, 256, 100_000, 9, 10)])
def test_divergence(spark, monkeypatch, least, tile, slice_, leaves, chunk):
    for name, value in (("SLICE", slice_), ("LEAVES", leaves), ("CHUNK", chunk), ("ROWS", 3), ("MERGED", leaves)):
        monkeypatch.setattr(divergence, name, value)
    docs = some_docs(least)
    df = spark.createDataFrame([(k % 50, *d, "x", 1, "y") for k, d in enumerate(docs)], DOC)
    got = divergence.audit(df, least, 4, tile)
    assert rows(got, *AUDIT) == brute_audit(docs, least, 4)


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOC)).count() == 0


def test_colliding_hashes_of_terms(monkeypatch):
    """Terms are told apart by themselves."""
    monkeypatch.setattr(divergence, "word_hashes", lambda data, a, b: np.zeros(len(a), np.uint64))
    trie = divergence.RadixTrie()
    divergence._add(trie, ["b a b", "c b"], np.array([0, 1]))
    assert counters(trie) == [(b"a", {0: (1, 1)}), (b"b", {0: (2, 1), 1: (1, 1)}), (b"c", {1: (1, 1)})]
