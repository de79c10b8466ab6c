import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodeworks.llm.bpe import PrefixCounts, WordIds
from lodeworks.llm.packing import pack, places, rounds, sequences
from lodeworks.llm.prefix_tokens import longest_prefix, prefix_table, tokens_at

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "a  b", "a\n\n b", "  \n x \t\ty", "don't 're 'rex ''s l'll 'l", "<|endoftext|>", "hi <|endoftext|> there<|endoftext|>x <|endo", "ÅΣΑΣ ΟΔΟΣ İstanbul ǅ", "中文字 テスト 1234 ²½",
    "\x1c a\x1db \x85 x\xa0y", "é é", "", "   ", "\n", "a" * 900 + " " * 300 + "x", "😀😀 👍🏽", "a.b,,c ... d", "<|startoftext|> a", "`password=ab12'",
]


def test_ids_are_the_library_s():
    own, library = WordIds(WORDS), Tokenizer.from_file(WORDS)
    for text in ODD:
        assert np.frombuffer(own.ids(text), own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_every_prefix_count_is_the_library_s():
    own, library = PrefixCounts(BYTES), Tokenizer.from_file(BYTES)
    for text in ODD:
        steps = own.steps(text)
        for k in range(len(text) + 1):
            assert tokens_at(steps, k) == len(library.encode(text[:k], add_special_tokens=False).ids), (text, k)
    steps = own.steps("one two three four")
    assert longest_prefix(steps, 2) == len("one two") and longest_prefix(steps, 0) == 0


def test_prefix_table(docs):
    rows = prefix_table(docs, BYTES, (3,)).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    assert (by[3].n_bytes, by[3].n_tokens) == (0, 0) and (by[4].n_bytes, by[4].n_tokens) == (0, 0)
    assert by[7].n_tokens == 2 and by[7].cuts == [7]


def test_packing_is_an_exact_partition(spark, docs):
    pieces = pack(docs, WORDS, window=64, quantum=4)
    rows = pieces.collect()
    library = Tokenizer.from_file(WORDS)
    ids = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    got = {}
    for r in sorted(rows, key=lambda r: r.start):
        got.setdefault(r.doc_id, []).append(r)
    for k, v in got.items():
        flat = [x for r in v for x in np.frombuffer(r.ids, "<u4").tolist()]
        assert sorted(flat) == sorted(ids[k] * (2 if k == 1 else 1))
    ends = [sum(p.length for p in s.pieces) for s in sequences(pieces).orderBy("sequence_id").collect()]
    assert all(e == 64 for e in ends[:-1]) and 0 < ends[-1] <= 64
    for s in sequences(pieces).collect():
        at = 0
        for p in s.pieces:
            assert p.offset == at
            at += p.length
    digest = pieces.select(F.crc32("ids").alias("c"), "ids").first()
    assert digest.c == zlib.crc32(digest.ids)


@pytest.mark.parametrize("weights", [None, [5.0, 2.0, 1.0]])
def test_rounds_fill_windows_in_proportion(weights):
    totals = [20_000, 7_000, 3_001]
    phases = rounds(totals, weights, 256, 8)
    owner = np.full(sum(totals), -1)
    for q, t in enumerate(totals):
        for a in range(0, t, 997):
            for token, place, length in places(q, a, min(a + 997, t), phases, totals, 8):
                assert (owner[place : place + length] == -1).all() and a <= token < a + 997
                owner[place : place + length] = q
    assert (owner >= 0).all()
    share = np.array(weights or totals, float) / sum(weights or totals)
    for w in range(10):
        held = np.bincount(owner[w * 256 : (w + 1) * 256], minlength=3)
        assert np.abs(held - 256 * share).max() <= 3 * 8 + 8


def test_empty_tables(docs):
    none = docs.where("false")
    assert pack(none, WORDS).count() == 0 and prefix_table(none, BYTES).count() == 0


def test_special_strings_without_end():
    own, library = PrefixCounts(BYTES), Tokenizer.from_file(BYTES)
    text = "<|endoftext|>" * 3000 + "a <|endoftext|> b" + "<|endoftext|" * 3
    steps = own.steps(text)
    assert len(steps) == 2 * len(text) and tokens_at(steps, len(text)) == len(library.encode(text, add_special_tokens=False).ids)
    for k in (0, 5, 13, 14, 26, len(text) - 40, len(text) - 1):
        assert tokens_at(steps, k) == len(library.encode(text[:k], add_special_tokens=False).ids), k


def test_memo_is_bounded_by_bytes(monkeypatch):
    from lodeworks.llm import bpe

    monkeypatch.setattr(bpe, "MEMO", 20_000)
    memo = bpe.Memo(lambda k: (k * 4).encode())
    for i in range(5000):
        assert memo.get(f"key {i}" * 5) == (f"key {i}" * 20).encode()
    assert len(memo.new) + len(memo.old) < 250


def many_sources(spark, n):
    rows = [(i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(5 + i * 13 % 90)), f"s{i % n:03}" if i % 9 else None) for i in range(900)]
    rows += [(2000 + i, "hot source words here " * 8, "hot") for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)


@pytest.mark.parametrize("weighted", [False, True])
def test_packing_keeps_the_proportions_of_any_number_of_sources(spark, weighted):
    """Eight queues for some two hundred sources: the last is shared, and all get their part of every stretch."""
    docs, window = many_sources(spark, 300), 256
    source = {r.doc_id: r.source for r in docs.collect()}
    names = sorted({s for s in source.values() if s})
    weights = {s: 1.0 + k % 3 for k, s in enumerate(names)} if weighted else None
    rows = pack(docs, WORDS, window=window, quantum=8, weights=weights, queues=8).collect()
    total, place, ends = {}, {}, {}
    for r in rows:
        s = source[r.doc_id]
        total[s] = total.get(s, 0) + r.length
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
        place.setdefault(s, []).append((r.sequence_id * window + r.offset, r.length))
    for k, pieces in ends.items():  # gapless, all full but the last
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at == window or k == max(ends)
    for d in {r.doc_id for r in rows}:
        own = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.start)
        at = 0
        for r in own:
            assert r.start == at
            at += r.length
        assert at == own[0].doc_tokens
    whole = sum(total.values())
    assert len({r.queue for r in rows}) == 8 and len(total) > 100
    sent = lambda s, upto: sum(max(0, min(n, upto - p)) for p, n in place[s])
    if not weighted:
        for s, t in total.items():
            for upto in range(0, whole - 2 * window, 4 * window):
                assert abs(sent(s, upto) - t * upto / whole) <= 2 * window, (s, upto)
    else:  # while all weighted sources last, they are served by their weights; the null source comes last
        first = min(total[s] / weights[s] for s in names)
        upto = int(first * sum(weights.values()) * 0.8)
        for s in names:
            assert abs(sent(s, upto) - weights[s] * upto / sum(weights.values())) <= 2 * window, s
        assert min(p for p, _ in place[None]) >= 0.6 * whole


def test_packing_edges(spark, docs):
    assert pack(docs.where("false"), WORDS).count() == 0
    one = pack(docs.where("doc_id = 3"), WORDS).collect()
    assert [(r.start, r.length, r.sequence_id, r.offset) for r in one] == [(0, 1, 0, 0)] and np.frombuffer(one[0].ids, "<u4").tolist() == [1]


def test_words_are_remembered_once():
    """Chunks alone are remembered, and short cuts for ASCII give what the library gives."""
    import random

    import numpy as np
    import public_tokenizers

    from lodeworks.llm import bpe

    own = bpe.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    assert [k for k, v in vars(own).items() if isinstance(v, bpe.Memo)] == ["chunk"]
    rng = random.Random(3)
    odd = ["don't", "I'LL", "'s", "we're's", "12ab3", "a_b", "\x00a", "\x7fq", "Ünd'ER", "İstanbul", "naïve42!"]
    odd += ["".join(rng.choice("abAB'sStTrevmMlLdD01.,-_!\x00\x7f~é") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    for piece in odd:
        assert np.frombuffer(own.ids(piece), own.dtype).tolist() == own.library.encode(piece, add_special_tokens=False).ids, piece
