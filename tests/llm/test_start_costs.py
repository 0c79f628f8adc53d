"""What a task pays before its first text."""

import numpy as np

from quillspark.llm import language_id, sentencepiece_codec


def test_letter_codes_reach_as_far_as_the_texts():
    space, whole = language_id.Hyperspace(64), language_id.Hyperspace(64)
    whole.letter_codes()
    for text in ("plain words", "中文 text", "\U00020000\U0010ffff", "", None, "ab" * 3):
        assert all((a == b).all() for a, b in zip(space.grams(text), whole.grams(text)))
    short = language_id.Hyperspace(64)
    short.grams("plain words")
    assert len(short.codes) < 0x10000


def test_forgotten_grams_are_made_anew(monkeypatch):
    texts = ["some words here", "other words there", "some words here", "été"]
    space = language_id.Hyperspace(64)
    kept = [space.bundle(t) for t in texts]
    monkeypatch.setattr(language_id, "KEPT_GRAMS", 12)
    space = language_id.Hyperspace(64)
    assert all(np.array_equal(a, space.bundle(t)) for a, t in zip(kept, texts))
    assert isinstance(space.row_of, np.ndarray)


def test_the_model_is_read_once(monkeypatch):
    read, model = [], sentencepiece_codec.PieceModel
    monkeypatch.setattr(sentencepiece_codec, "PieceModel", lambda data: read.append(1) or model(data))
    with open(sentencepiece_codec.default_model(), "rb") as f:
        sentencepiece_codec.codec(f.read(), 1, False)
    assert len(read) == 1
