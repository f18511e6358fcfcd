"""Token counts, encoding and decoding against the library that reads the same file."""

import hashlib
import random

import numpy as np
import pytest

from lintlake.llm.bpe_rounds import decode_ids, encode_texts
from lintlake.llm.piece_model import piece_model
from lintlake.llm.queries import piece_model_path
from lintlake.llm.sentencepiece_bpe import decode_documents, digests, encode_and_decode, encode_documents
from lintlake.llm.token_counts import token_report
from lintlake.llm.token_transducer import count_tokens, transducer


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_model_path())


@pytest.fixture(scope="module")
def texts(library):
    rng = random.Random(3)
    parts = list("abcdeeett  ▁▁\n\t. ,éèß漢字日本 aaa==--**//👍🏽À́​<s>01") + ["the", "ing", " of", "    ", "▁" * 17]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    pieces = [library.id_to_piece(i) for i in range(3, library.vocab_size())]
    made += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 8))) for _ in range(2000)]
    made += [c * k for c in ("a", " ", "=", "ab", "\n", "é") for k in range(40)]
    return made + ["", "<0x0A></s>", "x" * 3000, " " * 20000 + "y", "word " * 20000]


def test_encode_decode_as_library(library, texts):
    model = piece_model(piece_model_path())
    for limit in (100, 1_000_000):  # parts of long texts meet where no piece can stand
        for text, own, theirs in zip(texts, encode_texts(model, texts, limit), library.encode(texts), strict=True):
            assert own.tolist() == theirs, text[:80]
            assert decode_ids(model, np.r_[1, own, 2]) == library.decode([1, *theirs, 2])


def test_counts_as_library(library, texts):
    machine = transducer(piece_model_path())
    wanted = [len(ids) for ids in library.encode(texts)]
    assert count_tokens(machine, texts).tolist() == wanted


def test_chunk_maps_compose(texts):
    """Chunks of any length, however a word falls into them, give the same changes."""
    from lintlake.llm.bpe_rounds import codes_of

    machine = transducer(piece_model_path())
    codes, bounds = codes_of([" " + t for t in texts[:300]] + ["unbroken" * 100])
    whole = machine.changes(codes, bounds, chunk=len(codes))
    for chunk in (1, 3, 64):
        assert (machine.changes(codes, bounds, chunk) == whole).all()


def test_table_is_emptied_when_full(library, texts, monkeypatch):
    import lintlake.llm.token_transducer as module

    monkeypatch.setattr(module, "TABLE_CELLS", 1)
    machine = module.Transducer(piece_model(piece_model_path()))
    for text in texts[::40]:
        assert count_tokens(machine, [text])[0] == len(library.encode(text))


def test_documents(library, odd_docs):
    texts = [r.text or "" for r in odd_docs.collect()]
    found = digests(encode_and_decode(odd_docs, piece_model_path())).collect()
    assert len(found) == len(texts)
    wanted = set()
    for text in texts:
        ids = [library.bos_id(), *library.encode(text), library.eos_id()]
        raw = np.array(ids, "<u4").tobytes()
        wanted.add((len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found} == wanted
    counted = token_report(odd_docs, piece_model_path(), limit=10).collect()
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in counted) == sorted(
        (len(t.encode()), len(library.encode(t)), len(library.encode(t)) > 10) for t in texts
    )


def test_clashing_and_extra_columns(make_docs):
    docs = make_docs([(1, "a b")]).selectExpr("*", "'x' AS Token_IDs", "1 AS more", "2 AS N_Tokens")
    encoded = encode_documents(docs, piece_model_path(), begin=False, end=False)
    row = decode_documents(encoded, piece_model_path()).first()
    assert (row.more, row.decoded, len(row.token_ids)) == (1, "a b", 8)
    assert token_report(docs, piece_model_path()).first().n_tokens == 2


def test_empty_table(make_docs):
    assert digests(encode_and_decode(make_docs([]), piece_model_path())).count() == 0
    assert token_report(make_docs([]), piece_model_path()).count() == 0


def _without_prefix(proto):
    proto.normalizer_spec.add_dummy_prefix = False


def _fewer_blanks(proto):
    proto.normalizer_spec.remove_extra_whitespaces = True


def _no_merge_order(proto):
    for piece in proto.pieces[300:]:
        piece.score -= 0.5


@pytest.mark.parametrize("change", [_without_prefix, _fewer_blanks, _no_merge_order])
def test_models_with_other_rules_are_refused(library, tmp_path, change):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto.FromString(library.serialized_model_proto())
    change(proto)
    path = tmp_path / "other.model"
    path.write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError):
        piece_model(str(path))
