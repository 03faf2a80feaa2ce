"""SentencePiece encoding and decoding by a streaming Viterbi search, for BPE and unigram models."""

from __future__ import annotations

import hashlib
import re
import threading
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the tokenizer's file is; a parameter of every entry point.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: A model goes to every task; larger files are refused.
MAX_MODEL_BYTES = 64 << 20
#: Remembered words (twice as many at most) and piece pairs, per Python worker: about 200 MB.
MAX_WORDS, MAX_PAIRS = 300_000, 500_000
#: Seconds that a worker without a task still remembers them.
KEPT_SECONDS = 5.0
#: Longer chunks are searched like any other and not remembered.
REMEMBERED_CHARS = 48
#: Characters that a class has at least to be told apart from the rest when a text is cut into chunks.
LARGE_CLASS = 16
#: Characters that the search is fed at a time.
FED_CHARS = 4096
BATCH_BYTES = 8 << 20

SPACE = "▁"
_UNKNOWN = -1  # a character that no piece has; it becomes its UTF-8 bytes, or the unknown id


class PieceModel:
    """What a model file says: pieces, scores, and how a text is prepared. Only the identity normaliser is supported."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        if len(data) > MAX_MODEL_BYTES:
            raise ValueError(f"the model has {len(data)} bytes; at most {MAX_MODEL_BYTES} are allowed")
        self.digest = hashlib.sha256(data).hexdigest()
        proto = pb.ModelProto()
        proto.ParseFromString(data)
        if proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models with the identity normaliser that keep white space are supported")
        kinds = {t.name: t.number for t in pb.ModelProto.SentencePiece.Type.DESCRIPTOR.values}
        self.unigram = proto.trainer_spec.model_type == pb.TrainerSpec.UNIGRAM
        if not self.unigram and proto.trainer_spec.model_type != pb.TrainerSpec.BPE:
            raise ValueError("only BPE and unigram models are supported")
        self.prefix = SPACE if proto.normalizer_spec.add_dummy_prefix else ""
        self.ids: dict[str, int] = {}
        self.scores: list[float] = []
        self.bytes_of: list[bytes] = []
        self.byte_ids: dict[int, int] = {}
        self.unk_id = proto.trainer_spec.unk_id
        for i, p in enumerate(proto.pieces):
            self.scores.append(p.score)
            self.bytes_of.append(b"")
            if p.type == kinds["BYTE"]:
                value = int(p.piece[1:-1], 16)
                self.byte_ids[value] = i
                self.bytes_of[i] = bytes([value])
            elif p.type == kinds["UNKNOWN"]:
                self.bytes_of[i] = proto.trainer_spec.unk_surface.encode()
            elif p.type != kinds["CONTROL"]:
                self.ids[p.piece] = i
                self.bytes_of[i] = p.piece.encode()
        if not proto.trainer_spec.byte_fallback:
            self.byte_ids = {}

    @classmethod
    def load(cls, path: str) -> PieceModel:
        with open(path, "rb") as f:
            return cls(f.read(MAX_MODEL_BYTES + 1))


def _chunks(pieces: Iterable[str]) -> re.Pattern | None:
    """What cuts a text where the search can start anew: between characters that stand side by side in no piece.

    Characters of pieces fall into classes, such as scripts and punctuation, in which each is linked to the others by
    pieces. A chunk is a run of one of the large classes, or of anything else, with the space marks before it. None if a
    piece has a space mark after another character.
    """
    parent: dict[str, str] = {}

    def top(char: str) -> str:
        while parent.setdefault(char, char) != char:
            char = parent[char]
        return char

    for piece in pieces:
        body = piece.lstrip(SPACE)
        if SPACE in body:
            return None
        for one, other in zip(body, body[1:] or body):
            parent[top(one)] = top(other)
    classes: dict[str, str] = {}
    for char in sorted(parent):
        classes[top(char)] = classes.get(top(char), "") + char
    large = ["".join(map(re.escape, chars)) for chars in classes.values() if len(chars) >= LARGE_CLASS]
    runs = [f"[{chars}]+" for chars in large] + [f"[^{''.join(large)}{SPACE}]+"]
    return re.compile("|".join(f"{SPACE}*{run}" for run in runs) + f"|{SPACE}+")


class _Words(dict):
    """The ids of words, searched for when first asked for. When full, words not asked for since it was last full go.

    Long words are not remembered.
    """

    def __init__(self, search: Callable[[str], bytes]):
        self.search = search
        self.before: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self.search(word)
            if len(word) > REMEMBERED_CHARS:
                return ids
        if len(self) >= MAX_WORDS:
            self.before = dict(self)
            self.clear()
        self[word] = ids
        return ids


class SentencePieceCodec:
    """Encodes and decodes with one model."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.longest = max(map(len, model.ids), default=1)
        self.chunks = _chunks(model.ids)
        self.words = _Words(self._packed)
        self.pairs: dict[int, bool] = {}
        self.pieces = {i: p for p, i in model.ids.items()}
        self.lengths = [len(self.pieces.get(i, "")) for i in range(len(model.scores))]
        #: character: the tree of how longer pieces go on, and the piece that ends here
        self.tree: dict[str, tuple[dict, int]] = {}
        for p, i in model.ids.items():
            node = self.tree
            for char in p[:-1]:
                node = node.setdefault(char, ({}, _UNKNOWN))[0]
            node[p[-1]] = node.get(p[-1], ({}, _UNKNOWN))[0], i
        self.score_of = {p: model.scores[i] for p, i in model.ids.items()}
        self.unk_score = min(model.scores, default=0.0) - 10.0

    def merged(self, text: str) -> list[str]:
        """What merging pairs gives for a short text: the best scored pair first, the leftmost of equal ones."""
        score, none, parts = self.score_of.get, -np.inf, list(text)
        gains = [score(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
        while gains and (best := max(gains)) > none:
            at = gains.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del gains[at]
            if at:
                gains[at - 1] = score(parts[at - 1] + parts[at], none)
            if at < len(gains):
                gains[at] = score(parts[at] + parts[at + 1], none)
        return parts

    def follows(self, before: str, piece: str) -> bool:
        """Whether merging leaves these two as neighbours; with an empty first, whether it makes the piece at all."""
        return self.merged(before + piece) == ([before, piece] if before else [piece])

    def search(self) -> StreamingViterbi:
        return StreamingViterbi(self)

    def ids_of(self, pieces: list[int]) -> list[int]:
        """Ids of what a search hands out: characters that no piece has become their bytes."""
        if not pieces or min(pieces) >= 0:
            return pieces
        out, of_byte = [], self.model.byte_ids
        for p in pieces:
            if p >= 0:
                out.append(p)
            elif of_byte:
                out += [of_byte[b] for b in chr(~p).encode()]
            else:
                out.append(self.model.unk_id)
        return out

    def text_of(self, piece: int) -> str:
        return self.pieces[piece] if piece >= 0 else chr(~piece)

    def _follows(self, before: int, piece: int) -> bool:
        pieces = self.pieces
        known = self.follows(pieces[before] if before >= 0 else "", pieces[piece])
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        self.pairs[(before + 1) * (len(self.model.scores) + 1) + piece] = known
        return known

    def _packed(self, chunk: str) -> bytes:
        search, ids = self.search(), array("i")
        for i in range(0, len(chunk), FED_CHARS):
            ids.extend(self.ids_of(search.take(chunk[i : i + FED_CHARS])))
        ids.extend(self.ids_of(search.rest()))
        return ids.tobytes()

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.int32)
        marked = self.model.prefix + text.replace(" ", SPACE)
        chunks = [marked] if self.chunks is None else self.chunks.findall(marked)
        return np.frombuffer(b"".join(map(self.words.__getitem__, chunks)), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.model.bytes_of.__getitem__, ids.tolist()))
        text = data.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.model.prefix and text[:1] == " " else text


class StreamingViterbi:
    """The best way to cut a text into pieces, found while the text streams in.

    For every boundary there is one survivor: the last piece of the best cut of the text up to it. In a unigram model
    that is the piece with the highest total score. In a BPE model it is the only piece that merging can leave there:
    a cut is what merging gives just if every two neighbours in it are, so a piece ends a cut if it ends one up to its
    start and may follow that one's last piece.

    ``window`` has the boundaries that a piece may still begin at, the oldest first: the last one, and those from which
    on the text so far is the beginning of a longer piece. None lies further back than the longest piece. After each
    character the paths that lead to them are followed back; where all of them meet, the pieces before are final, handed
    out and forgotten. Nothing of the text itself is kept.
    """

    def __init__(self, codec: SentencePieceCodec):
        self.codec = codec
        self.at = self.done = 0  # boundaries up to which the text was taken in, and pieces handed out
        self.base = 0  # the boundary that ``last`` begins with
        self.last = [0]  # the last piece of each boundary's survivor; ~ the character's number if no piece has it
        #: (boundary, tree of how pieces go on after the text since, what the boundary's survivor says)
        self.window: list[tuple[int, dict, float]] = [(0, codec.tree, 0)]
        self.commits = 0  # how often pieces became final before the end

    def feed(self, text: str) -> list[str]:
        """Take in more text; return the pieces that have become final."""
        return [self.codec.text_of(p) for p in self.take(text)]

    def finish(self) -> list[str]:
        """The rest, when no more text comes."""
        return [self.codec.text_of(p) for p in self.rest()]

    def take(self, text: str) -> list[int]:
        """As :meth:`feed`, with pieces by number."""
        return self._best_scored(text) if self.codec.model.unigram else self._merged(text)

    def rest(self) -> list[int]:
        return self._hand_out(self.at)

    def _merged(self, text: str) -> list[int]:
        """For a BPE model. What a boundary's survivor says is its last piece, as a row of pairs."""
        codec, out, window, at = self.codec, [], self.window, self.at
        last, tree, pairs, many = self.last, codec.tree, codec.pairs, len(codec.model.scores) + 1
        for char in text:
            found, longer = _UNKNOWN, []
            for start, node, row in window:
                step = node.get(char)
                if step is not None:
                    node, piece = step
                    if node:
                        longer.append((start, node, row))
                    if piece >= 0 > found:
                        known = pairs.get(row + piece)
                        if known is None:
                            known = codec._follows(row // many - 1, piece)
                        if known:
                            found = piece
            at += 1
            if found >= 0:
                last.append(found)
                longer.append((at, tree, (found + 1) * many))
            else:
                last.append(~ord(char))
                longer.append((at, tree, 0))
            window = longer
            if window[0][0] > self.done:  # else all paths meet where pieces were handed out up to
                self.window, self.at = window, at
                out += self._settle()
        self.window, self.at = window, at
        return out

    def _best_scored(self, text: str) -> list[int]:
        """For a unigram model. What a boundary's survivor says is its total score. Of equal paths the longest piece wins."""
        codec, out = self.codec, []
        scores = codec.model.scores
        for char in text:
            best, longer, alone = None, [], codec.tree.get(char, ({}, _UNKNOWN))[1] < 0
            for start, node, total in self.window:
                node, piece = node.get(char, ({}, _UNKNOWN))
                if node:
                    longer.append((start, node, total))
                if piece >= 0 and (best is None or total + scores[piece] > best[0]):
                    best = total + scores[piece], piece
                if alone and start == self.at and (best is None or total + codec.unk_score > best[0]):
                    best = total + codec.unk_score, ~ord(char)
            self.at += 1
            self.last.append(best[1])
            longer.append((self.at, codec.tree, best[0]))
            self.window = longer
            if longer[0][0] > self.done:
                out += self._settle()
        return out

    def _settle(self) -> list[int]:
        """Hand out what all survivors share."""
        live = [start for start, _, _ in self.window]
        if len(live) > 1:
            last, base, lengths = self.last, self.base, self.codec.lengths
            while len(live) > 1:
                far = live.pop()
                piece = last[far - base]
                back = far - (lengths[piece] if piece >= 0 else 1)
                at = len(live)
                while at and live[at - 1] > back:
                    at -= 1
                if not at or live[at - 1] != back:
                    live.insert(at, back)
        if live[0] == self.done:
            return []
        self.commits += 1
        return self._hand_out(live[0])

    def _hand_out(self, boundary: int) -> list[int]:
        pieces, at, last, base, lengths = [], boundary, self.last, self.base, self.codec.lengths
        while at > self.done:
            piece = last[at - base]
            pieces.append(piece)
            at -= lengths[piece] if piece >= 0 else 1
        self.done = boundary
        if boundary - base > 4 * self.codec.longest:
            del last[: boundary - base]
            self.base = boundary
        pieces.reverse()
        return pieces


class _Kept:
    """The codec of a model, with the words and pairs it knows, for the tasks that a worker runs one after another."""

    def __init__(self):
        self.codec: SentencePieceCodec | None = None
        self.digest = ""
        self.timer: threading.Timer | None = None

    def take(self, model: PieceModel) -> SentencePieceCodec:
        if self.timer:
            self.timer.cancel()
        codec = self.codec  # the timer may still run
        if codec is None or self.digest != model.digest:
            codec = self.codec = SentencePieceCodec(model)
            self.digest = model.digest
        return codec

    def leave(self) -> None:
        """No task needs it now; unless one comes soon, its memory is given back."""
        self.timer = threading.Timer(KEPT_SECONDS, self.forget)
        self.timer.daemon = True
        self.timer.start()

    def forget(self) -> None:
        self.codec = None


_KEPT = _Kept()


def _encoded(batches: Iterator[pa.RecordBatch], codec: SentencePieceCodec) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        start, size, ids, whole = 0, 0, [], []
        for i in range(batch.num_rows):
            text = batch.column(1)[i].as_py() or ""
            ids.append(codec.encode(text))
            whole.append(codec.decode(ids[-1]) == text.replace(SPACE, " "))
            size += ids[-1].nbytes
            if size >= BATCH_BYTES or i == batch.num_rows - 1:
                lengths = [len(x) for x in ids]
                offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))
                flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32))
                yield pa.record_batch(
                    [
                        batch.column(0).slice(start, i + 1 - start),
                        pa.array(lengths, pa.int64()),
                        pa.ListArray.from_arrays(offsets, flat),
                        pa.array(whole, pa.bool_()),
                    ],
                    names=["id", "n_ids", "ids", "round_trip"],
                )
                start, size, ids, whole = i + 1, 0, [], []


def _encoder(model: PieceModel) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from poolwright.llm.sentencepiece_codec import _KEPT  # the worker's, not a copy that came with this function

        try:
            yield from _encoded(batches, _KEPT.take(model))
        finally:
            _KEPT.leave()

    return encoded


def encode_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str = MODEL_FILE
) -> DataFrame:
    """One row per input row: ``id_col``, n_ids long, ids array<int>, round_trip boolean.

    ids are what SentencePiece itself gives for the whole text. round_trip says that decoding them gives the text back
    (where the text has the space mark U+2581 itself, decoding gives a space, by the format's design).

    The model is read on the driver, checked to be small, and goes with the tasks, so executors need no file. Rows are
    independent: no shuffle. A word's ids are remembered in a bounded table, as no piece crosses the start of a word.

    Null and empty texts give no ids. Repeated rows and null ids are passed through. Other columns are not read. An
    empty table gives an empty result.
    """
    model = PieceModel.load(model_file)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_encoder(model), f"id {kind}, n_ids long, ids array<int>, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, ids_col: str = "ids", model_file: str = MODEL_FILE) -> DataFrame:
    """``encoded`` with a column text: its ids decoded. Null ids give an empty text; ids outside the model fail."""
    model = PieceModel.load(model_file)

    @F.pandas_udf("string")
    def decoded(column):  # noqa: ANN001, ANN202
        codec = SentencePieceCodec(model)
        return column.map(lambda x: "" if x is None else codec.decode(np.asarray(x, dtype=np.int64)))

    return encoded.withColumn("text", decoded(F.col(ids_col)))
