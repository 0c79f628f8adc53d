"""SentencePiece encoding and decoding on the tokenizers library, rebuilt from the model file."""

from __future__ import annotations

import os
import re
import struct

import numpy as np
from pyspark.sql import DataFrame

from quillspark.llm.common import map_rows

#: The public model; a parameter everywhere, and never part of the repository.
MODEL_FILE = "piece_bpe_32k.model"
#: Threads that the library may use in a task.
THREADS = 2
#: Marked words whose ids a task keeps.
KEPT_WORDS = 150_000
#: Characters of texts that are encoded and checked at a time, unless one text alone has more; bounds the lists of ids alive.
PART_CHARS = 200_000
#: Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
SPACE = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL_FILE)


def _fields(data: bytes):
    """(number, value) of each field of a protobuf message: ints for varints, bytes for the other wire types."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
            continue
        n = varint() if wire == 2 else {1: 8, 5: 4}[wire]
        yield key >> 3, data[at : at + n]
        at += n


class PieceModel:
    """Pieces with scores and kinds, and the settings that encoding needs."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback = UNIGRAM, False
        self.charsmap, self.dummy_prefix, self.squeeze = b"", True, True
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                self.pieces.append((piece, score, kind))
            elif number == 2:
                for n, v in _fields(value):
                    if n == 3:
                        self.kind = v
                    elif n == 35:
                        self.byte_fallback = bool(v)
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2:
                        self.charsmap = v
                    elif n == 3:
                        self.dummy_prefix = bool(v)
                    elif n == 4:
                        self.squeeze = bool(v)
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    @property
    def plain(self) -> bool:
        """Whether normalising changes nothing but the space marker."""
        return not self.charsmap and not self.squeeze

    def merges(self) -> list[tuple[str, str]]:
        """All ways to put a normal piece together from two others, best score first, as the model's merge order."""
        usable = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER, UNUSED)}
        found = []
        for piece, i in usable.items():
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if left in usable and right in usable:
                    found.append((-self.pieces[i][1], i, usable[left], usable[right], left, right))
        return [(left, right) for *_, left, right in sorted(found)]

    def words_apart(self) -> bool:
        """Whether no piece has a marker after another character, so that text may be cut before each marked word."""
        return not any(SPACE in p.lstrip(SPACE) for p, _, kind in self.pieces if kind in (NORMAL, USER, UNUSED))

    def tokenizer(self):
        """The same encoder and decoder in the tokenizers library."""
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        if self.kind == BPE:
            vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            model = models.BPE(
                vocab, self.merges(), unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback
            )
        elif self.kind == UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback)
        else:
            raise ValueError(f"models of kind {self.kind} are not supported")
        built = Tokenizer(model)
        steps = []
        if self.charsmap:
            steps.append(normalizers.Precompiled(self.charsmap))
        if self.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(SPACE))
        built.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", SPACE)])
        if self.words_apart():
            built.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}*[^{SPACE}]+|{SPACE}+"), "isolated")
        tail = [decoders.Strip(" ", 1, 0)] if self.dummy_prefix else []
        built.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
        return built


def _loaded(data: bytes, threads: int, model: PieceModel | None = None):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    model = model or PieceModel(data)
    return model, model.tokenizer()


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit numbers."""
    return np.array(ids, "<i4").tobytes()


def unpack(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<i4").tolist()


class WholeTexts:
    """Encodes, decodes and checks batches of whole texts."""

    def __init__(self, data: bytes, threads: int, verify: bool = True, model: PieceModel | None = None):
        self.model, self.tokenizer = _loaded(data, threads, model)
        self.threads, self.checker = threads, None
        if verify:
            import sentencepiece

            self.checker = sentencepiece.SentencePieceProcessor(model_proto=data)

    def encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decoded(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def same(self, texts: list[str], ids: list[list[int]]) -> list[bool | None]:
        """Whether the sentencepiece library gives the same ids; None if that is not to be checked."""
        if self.checker is None:
            return [None] * len(ids)
        return [a == b for a, b in zip(self.checker.encode(texts, num_threads=self.threads), ids)]

    def __call__(self, texts: list[str]) -> tuple[list[bytes], list[bool], list[bool | None]]:
        """The packed ids of each text; whether decoding gives the text back (or, if normalising changes texts, the ids); parity."""
        ids = self.encoded(texts)
        back = self.decoded(ids)
        equal = [a == b for a, b in zip(texts, back)] if self.model.plain else [a == b for a, b in zip(self.encoded(back), ids)]
        return [pack(i) for i in ids], equal, self.same(texts, ids)


class MarkedWords(WholeTexts):
    """The same for models that may be applied word by word: each word is encoded once while it is kept.

    No piece goes on over a space, so the ids of a text are those of its words in a row, each with the markers before it.
    New words are put in a row and encoded as one text; the words of the row are told apart by the marker that each
    begins with. Both checks are of each whole text: its joined ids are decoded, and sentencepiece encodes it anew.
    """

    def __init__(self, data: bytes, threads: int, verify: bool = True, model: PieceModel | None = None):
        from tokenizers import pre_tokenizers

        super().__init__(data, threads, verify, model)
        self.tokenizer.normalizer = None
        self.by_marker = pre_tokenizers.Metaspace(SPACE, "never", True)
        self.begins = np.array([p.startswith(SPACE) for p, _, _ in self.model.pieces])
        self.spelled = [
            bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(SPACE, " ").encode() for p, _, kind in self.model.pieces
        ]
        self.words: dict[str, bytes] = {}
        self.units = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def split(self, text: str) -> list[str]:
        """Words without their first marker; further markers of a run of spaces belong to the word behind."""
        if not text:
            return []
        if "  " in text or SPACE in text or text[0] == " ":
            return [u[1:] for u in self.units.findall(SPACE + text.replace(" ", SPACE))]
        return text.split(" ")

    def learn(self, words: list[str]) -> None:
        plain = [w for w in words if w and SPACE not in w]
        self._learn_row(plain)
        self._learn_each([w for w in words if not w or SPACE in w])

    def _learn_row(self, words: list[str]) -> None:
        if not words:
            return
        size = -(-len(words) // self.threads)
        rows = [words[i : i + size] for i in range(0, len(words), size)]
        self.tokenizer.pre_tokenizer = self.by_marker
        for row, ids in zip(rows, self.encoded([" " + " ".join(r) for r in rows])):
            numbers = np.array(ids, "<i4")
            cuts = (4 * np.flatnonzero(self.begins[numbers])).tolist()
            if len(cuts) != len(row):
                self._learn_each(row)  # some word of this row is special
            else:
                packed = numbers.tobytes()
                self.words.update(zip(row, [packed[i:j] for i, j in zip(cuts, [*cuts[1:], len(packed)])]))

    def _learn_each(self, words: list[str]) -> None:
        """Words one by one, each with all its markers as one piece of text."""
        self.tokenizer.pre_tokenizer = None
        self.words.update(zip(words, map(pack, self.encoded([SPACE + w for w in words]))))

    def __call__(self, texts: list[str]) -> tuple[list[bytes], list[bool], list[bool | None]]:
        split = [self.split(t) for t in texts]
        if len(self.words) > KEPT_WORDS:
            self.words = {}
        self.learn(list(set().union(*split).difference(self.words)))
        packed = [b"".join(map(self.words.__getitem__, words)) for words in split]
        ids = [unpack(p) for p in packed]
        return packed, [self._decodes(t, i) for t, i in zip(texts, ids)], self.same(texts, ids)

    def _decodes(self, text: str, ids: list[int]) -> bool:
        """Whether the ids of a whole text decode to it: by the bytes of the pieces, else by the library."""
        spelled = b"".join(map(self.spelled.__getitem__, ids))
        return spelled.removeprefix(b" ") == text.encode() or self.tokenizer.decode(ids, skip_special_tokens=False) == text


def parts(rows: list[tuple], most: int = PART_CHARS):
    """Rows (id, text, ...) in a row, cut so that the texts of a part have at most so many characters or are one."""
    part, chars = [], 0
    for row in rows:
        size = len(row[1] or "")
        if part and chars + size > most:
            yield part
            part, chars = [], 0
        part.append(row)
        chars += size
    if part:
        yield part


def codec(data: bytes, threads: int = THREADS, verify: bool = True) -> WholeTexts:
    model = PieceModel(data)
    marked = model.plain and model.dummy_prefix and model.words_apart() and any(p == SPACE for p, _, _ in model.pieces)
    return (MarkedWords if marked else WholeTexts)(data, threads, verify, model)


def encode_documents(
    docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    carry: tuple[str, ...] = (), threads: int = THREADS, verify: bool = True,
) -> DataFrame:
    """(id, *carry, ids, decoded_equal, parity), a row per input row, without a shuffle.

    ids are the token ids of the whole text, packed as little-endian 32-bit numbers. decoded_equal: decoding them gives the text back (for models whose
    normaliser changes texts: gives what re-encodes to the same ids). parity: the ids equal those of the sentencepiece
    library, null if verify is off. Null text: null ids, decoded_equal and parity null; empty text: no ids.
    Repeated rows get equal results. An empty table gives no rows. The model's bytes travel with the task.
    """
    with open(model_path or default_model(), "rb") as f:
        data = f.read()

    def start():
        apply = codec(data, threads, verify)

        def step(rows):
            for part in parts(list(rows)):
                results = iter(zip(*apply([r[1] for r in part if r[1] is not None])))
                for key, text, *rest in part:
                    yield (key, *rest, *(next(results) if text is not None else (None, None, None)))

        return step

    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(
        docs.select(id_col, text_col, *carry), f"`{id_col}` {kind}{kinds}, ids binary, decoded_equal boolean, parity boolean", start
    )


def decode_documents(rows: DataFrame, model_path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from (id, ids); null ids give null text."""
    with open(model_path or default_model(), "rb") as f:
        data = f.read()

    def start():
        _, tokenizer = _loaded(data, THREADS)

        def step(batch):
            for key, ids in batch:
                yield key, None if ids is None else tokenizer.decode(unpack(ids), skip_special_tokens=False)

        return step

    kind = rows.schema[id_col].dataType.simpleString()
    return map_rows(rows.select(id_col, ids_col), f"`{id_col}` {kind}, text string", start)
