"""Token codes and packing against the tokenizers library used plainly."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from weekcast.llm import harmonic_packing as H, token_codes as T
from weekcast.llm.tokens import OTHER_WHITE, ChunkCodes, packed

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
TEXTS = [None, "", " ", "\n\n", "a", "Ouwhea the of.\nRend, and!! it's", "tab\there  two  blanks \n end ", "\x1c!\x1c x\x85y", "é é Σ ΑΣ ﬁ 日本語。 x", "<|endoftext|> as text", "a<|endoftext|>b.  <|endoftext|>  <|startoftext|>!", " İ;", "İ. i̇; ǰ! ﬁ, ŉ: ẞ.", "x" * 9000, "a,b.c;; d ,e ...f 'S"]


def plain(name, names_as_text=False):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = names_as_text
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("names_as_text", [False, True])
@pytest.mark.parametrize("name", FILES)
def test_chunked_ids_are_those_of_the_whole_text(name, names_as_text):
    codes, whole = ChunkCodes(public_tokenizers.path(name), keep=5, names_as_text=names_as_text), plain(name, names_as_text)

    @settings(max_examples=150, deadline=None)
    @given(st.text(alphabet=st.sampled_from("aBé.,!'s \n\t\x1c 7ßΣ_-日"), max_size=40))
    def check(text):
        assert np.frombuffer(codes.encode(text), "<u4").tolist() == whole(text)

    check()
    for text in TEXTS:
        assert np.frombuffer(codes.encode(text), "<u4").tolist() == whole(text)


def documents(spark, rows):
    """Rows (doc_id, text) with further columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, part string, number int, ids int")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0, 1, 255, 256, 70_000, 2**24, 2**32 - 1]), max_size=700), max_size=4))
def test_segments_give_back_every_token(docs):
    blobs = [np.array(d, "<u4").tobytes() for d in docs]
    held = T.Segment(T.pack_segment([None, *range(1, len(docs))][: len(docs)], blobs))
    flat = [x for d in docs for x in d]
    assert held.all_tokens().tolist() == flat
    assert [held.token(k) for k in range(len(flat))] == flat
    assert held.doc_ids == [None, *range(1, len(docs))][: len(docs)]
    with pytest.raises(IndexError):
        held.token(len(flat))


def test_written_codes_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "SEGMENT_TOKENS", 50)
    rows = [(7 * k % 31 - 5, t) for k, t in enumerate(TEXTS * 3)] + [(None, "no id"), (3, "twice"), (3, "twice")]
    path, whole = str(tmp_path / "codes"), plain(FILES[0])
    T.write_codes(documents(spark, rows), path, public_tokenizers.path(FILES[0]), 2)
    got = sorted(T.read_codes(spark, path).collect(), key=lambda r: r["start"])
    want, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*whole(text), 2], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [(r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in got] == want
    ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in got])
    places = [0, 1, 77, start - 1, start, -1, 77]
    found = T.look_up(spark, path, spark.createDataFrame([(p,) for p in places], "place long")).collect()
    assert {r["place"]: r["id"] for r in found} == {p: int(ids[p]) for p in places if 0 <= p < start} and len(found) == 4


def test_no_documents(spark, tmp_path):
    none = documents(spark, [])
    T.write_codes(none, str(tmp_path / "none"), public_tokenizers.path(FILES[0]), 2)
    assert T.read_codes(spark, str(tmp_path / "none")).count() == 0
    assert H.pack(none, public_tokenizers.path(FILES[1]), 2).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 30_000))
def test_pieces_fit_their_classes(n):
    pieces = H.cut(n)
    assert sum(pieces) == n
    assert all(p < 64 or 4096 % p == 0 for p in pieces) and sum(p < 64 for p in pieces) <= 1


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.sampled_from([4096, 2048, 512, 64, *range(1, 64)]), st.integers(0, 9000), max_size=12))
def test_runs_place_every_number_once_and_without_gaps(totals):
    runs, filled, seen = H.lay_out(totals), {}, {}
    for length, first, end, fit, sequence, offset in runs:
        seen.setdefault(length, []).append((first, end))
        for number in range(first, end):
            filled.setdefault(sequence + (number - first) // fit, []).append((offset + (number - first) % fit * length, length))
    for length, total in totals.items():
        assert sorted(x for a, b in seen.get(length, []) for x in range(a, b)) == list(range(total))
    assert sorted(filled) == list(range(len(filled)))
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    # A sequence lacks less than a tail; one may lack more.
    loose = sorted(4096 - sum(x for _, x in p) for p in filled.values())
    assert all(x < 64 for x in loose[:-1])


def test_packed_pieces_give_back_the_documents(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "no id"), (3, "again"), (3, "again"), (99, "word " * 5000)]
    whole = plain(FILES[1])
    got = H.pack(documents(spark, rows).repartition(3), public_tokenizers.path(FILES[1]), 2).collect()
    assert sum(r["length"] for r in got) == sum(len(whole(t)) + 1 for _, t in rows)
    one = sorted((r for r in got if r["doc_id"] == 99), key=lambda r: r["start"])
    assert b"".join(r["ids"] for r in one) == np.array([*whole("word " * 5000), 2], "<u4").tobytes()
    assert [r["start"] for r in one] == list(np.cumsum([0, *[r["length"] for r in one]])[:-1])
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        ends = np.cumsum([0, *[n for _, n in sorted(pieces)]])
        assert [o for o, _ in sorted(pieces)] == list(ends[:-1]) and ends[-1] <= 4096


def test_ids_are_packed_as_little_endian_integers():
    for n in (0, 1, 32, 33, 500):
        ids = [(k * 7919 + n) % (1 << 32) for k in range(n)]
        assert packed(ids) == b"".join(i.to_bytes(4, "little") for i in ids)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_of_ascii_letters_go_to_the_model_as_they_stand(name):
    """The form of a word needs no detour over bytes, and gives the ids of the whole tokenizer."""
    codes = ChunkCodes(public_tokenizers.path(name))
    assert codes.word and all(codes.word(w).lstrip("\u0120").lower() == w.lower() for w in ("Probe", "thonerea", "ABC"))
    for word in ("Probe", "thonerea", "ABC", "the", "xqzvkjw"):
        assert codes[word] == packed(codes.plain(" " + word))


@pytest.mark.parametrize("name", FILES)
def test_words_with_accents_and_marks_need_no_detour(name, monkeypatch):
    """Only marks and, where a line feed is no blank, words after one go through the whole tokenizer; ids stay those of the whole text."""
    codes, whole = ChunkCodes(public_tokenizers.path(name)), plain(name)
    words = ["été", "ÉTÉ", "über", "Ünd", "пион", "ДЫМ", "naïve"]
    text = " ".join([*words, *(w + "$$$" for w in words), *(w + ",#&" for w in words)]) + "".join("\n" + w + "%*" for w in words if name == FILES[1])
    asked = []
    inner = ChunkCodes.plain
    monkeypatch.setattr(ChunkCodes, "plain", lambda self, text: asked.append(text) or inner(self, text))
    assert np.frombuffer(codes.encode(text), "<u4").tolist() == whole(text)
    assert set(asked) <= {"$$$", ",#&", "%*", "été"}
    for odd in ("é$́ x", "a<|endoftext|>$ b", "\n<|endoftext|>*", "a\xa0b", "　a b", "\n!\n7 é\n's", "й%&\nЙ #$ µ ª º×÷"):
        assert np.frombuffer(codes.encode(odd), "<u4").tolist() == whole(odd)


def test_other_white_space_is_known():
    assert "".join(OTHER_WHITE) == "".join(c for c in map(chr, range(0x110000)) if c.isspace() and c not in " \n")
