import random

import numpy as np
import pytest

from docweave.llm.pieces import _BYTE, _NORMAL, _UNKNOWN, DoubleArray, Pieces, decode, encode, round_trips


@pytest.fixture(scope="module")
def public():
    import public_tokenizers

    return Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))


def small(byte_pieces=True, seed=1):
    rng = random.Random(seed)
    rows = [("<unk>", 0.0, _UNKNOWN)] + [(f"<0x{b:02X}>", 0.0, _BYTE) for b in range(256) if byte_pieces]
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 5))) for _ in range(40)} - {"é"}
    return Pieces.build(rows + [(p + w, -rng.randrange(1, 9) * 1.0, _NORMAL) for w in sorted(words) for p in ("", "▁")] + [("▁", -4.0, _NORMAL)])


def brute(model, text):
    """Best sum of scores over all segmentations of the whole text, without segments or a trie."""
    text = model.normalised(text)
    own = {p: s for p, s, k in zip(model.pieces, model.scores, model.kinds) if k == _NORMAL}
    best = [0.0] + [-np.inf] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in own:
                best[j] = max(best[j], best[i] + own[text[i:j]])
        best[i + 1] = max(best[i + 1], best[i] + min(own.values()) - 10)
    return best[-1]


def score_of(model, text, ids):
    """The sum of scores that ids stand for; byte pieces of one character cost once."""
    total, at, text = 0.0, 0, model.normalised(text).encode()
    while ids:
        if model.kinds[ids[0]] == _NORMAL:
            total += model.scores[ids[0]]
            at += len(model.pieces[ids[0]].encode())
            ids = ids[1:]
        else:
            n = next(k for k in (1, 2, 3, 4) if at + k == len(text) or text[at + k] & 0xC0 != 0x80)
            assert [model.pieces[i] for i in ids[:n]] == [f"<0x{b:02X}>" for b in text[at : at + n]]
            total += min(s for s, k in zip(model.scores, model.kinds) if k == _NORMAL) - 10
            at, ids = at + n, ids[n:]
    assert at == len(text)
    return total


def test_trie_holds_exactly_its_keys():
    rng = random.Random(4)
    keys = sorted({bytes(rng.choice([0, 97, 98, 255]) for _ in range(rng.randrange(1, 6))) for _ in range(300)})
    trie = DoubleArray(keys, list(range(len(keys))))
    for _ in range(500):
        text = bytes(rng.choice([0, 97, 98, 255]) for _ in range(8))
        want = [(n, keys.index(text[:n])) for n in range(1, 9) if text[:n] in keys]
        assert list(trie.prefixes(text, 0)) == want


def test_viterbi_is_optimal():
    model, rng = small(), random.Random(2)
    texts = ["".join(rng.choice("aabb éx  😀\n") for _ in range(rng.randrange(25))) for _ in range(300)]
    for text, ids in zip(texts, model.encode_batch(texts)):
        assert score_of(model, text, ids.tolist()) == pytest.approx(brute(model, text) if text else 0)
    one = [model.viterbi(model.normalised(t).encode()) for t in texts]
    assert one == [x.tolist() for x in model.encode_batch(texts)]
    model.cache.most = 5
    assert one == [x.tolist() for t in texts for x in model.encode_batch([t])]


def test_public_vocabulary_round_trips(public):
    rng = random.Random(3)
    alphabet = list("abcdefgh  \n\t") + ["é", "ß", "日", "😀", "\x00", "́", "  "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(500)] + [" ", "  a", "x" * 2000, "the quick brown fox"]
    for text, ids in zip(texts, public.encode_batch(texts)):
        assert public.decode(ids) == text
    import public_tokenizers
    import sentencepiece

    other = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert [public.decode(other.encode(t)) for t in texts] == texts
    assert [other.decode(x.tolist()) for x in public.encode_batch(["hello world", "a  b é 日 😀"])] == ["hello world", "a  b é 日 😀"]


def test_without_byte_pieces_the_unknown_piece_stands_in():
    model = small(False)
    assert model.encode_batch(["x"])[0][-1] == model.unknown_id


def test_frames(spark, public):
    rows = [(1, "one two", 5), (1, "one two", 5), (2, None, 5), (3, "", 5), (None, "é\n", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Ids int")
    both = encode(df, public)
    assert {(r["doc_id"], r["text"]) for r in decode(both, public).collect()} == {(1, "one two"), (2, ""), (3, ""), (None, "é\n")}
    out = round_trips(df, public).toPandas()
    assert len(out) == 5 and out.round_trip.all() and out.n_pieces.tolist()[2:4] == [0, 0]
    assert encode(df.limit(0), public).count() == 0


def _as_unigram(model: bytes) -> bytes:
    """A vocabulary file of merges with its type set to unigram and scores that are no ranks: only what both libraries then do is compared."""
    from docweave.llm.pieces import _fields

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def message(pairs):
        out = b""
        for number, value in pairs:
            if isinstance(value, int):
                out += varint(number << 3) + varint(value)
            elif isinstance(value, tuple):
                out += varint(number << 3 | 5) + value[0]
            else:
                out += varint(number << 3 | 2) + varint(len(value)) + value
        return out

    rng = random.Random(3)
    parts = []
    for number, value in _fields(model):
        if number == 1:
            own = dict(_fields(value))
            score = np.float32(-1 - len(own[1]) * 0.5 - rng.random() * 8).tobytes() if own.get(3, 1) == _NORMAL else bytes(own.get(2, bytes(4)))
            value = message([(1, bytes(own[1])), (2, (score,)), (3, own.get(3, 1))])
        elif number == 2:  # the trainer's settings: byte fallback and the type
            value = message([(3, 1), (35, 1)])
        parts.append((number, value))
    return message(parts)


def test_ids_are_those_of_the_library_for_unigram_vocabularies():
    import public_tokenizers
    import sentencepiece

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = _as_unigram(file.read())
    own, library = Pieces.parse(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(5)
    words = "the river Über naïve 東京 don't 12,5 ▁x 𝄞 <b> \t ok\n".split(" ") + ["", "aaaa", "supercalifragilistic"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(200)] + ["", "  two  spaces ", "x" * 500]
    same = [a.tolist() == b for a, b in zip(own.encode_batch(texts), library.encode(texts))]
    assert all(same), texts[same.index(False)]
