"""SentencePiece encoding and decoding as shortest paths through weighted finite-state transducers.

A model file is compiled into three machines: the normaliser (a sequential transducer: the character
map's automaton followed by the space rules), the lexicon (a trie of pieces over characters, with byte
pieces as the fallback of unknown characters) and, for models whose pieces come from merges, an
acceptor of adjacent pieces: two pieces may stand side by side only if merging their joined text
yields just these two. A sequence is what merging yields exactly if all its neighbours are, so among
all segmentations the one path of finite weight is the library's. For unigram models the pieces'
weights are their negative scores and there is no acceptor. An input is composed with the machines,
arc by arc as the search asks for them, and the result is the shortest path of the composition in the
tropical semiring (minimum, plus).

A null text counts as empty and has no pieces; a null id is kept; an empty table gives an empty
result; repeated rows are encoded each. Very long texts are composed word by word. Of paths of equal
weight the one is taken whose last piece begins first, as in the library. Only the id and the text
are read, so clashing names of other columns don't matter.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Memo
from .common import id_and_text, tidily

SPACE = "▁"  # fixed value: the sign for a space
INF = float("inf")
#: Words of a generation, and pairs, that a worker remembers.
NO_WORDS = 150_000
NO_PAIRS = 500_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: kinds of pieces in model files


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            yield tag >> 3, struct.unpack("<d" if n == 8 else "<f", data[at : at + n])[0]
            at += n


_RUNS = re.compile(" +|[^ ]+")


class Normaliser:
    """A sequential transducer from characters to normalised characters.

    Its first part is the automaton of the model's character map, whose longest matches are
    rewritten; all else passes through. Its second part has three states, that tell what the output
    so far ends in: nothing yet, a character, or spaces that are written only if a character follows.
    """

    START, INSIDE, GAP = 0, 1, 2

    def __init__(self, spec: dict):
        self.dummy_prefix, self.squeeze, self.escape = (bool(spec.get(n, 1)) for n in (3, 4, 5))
        self.space = SPACE if self.escape else " "
        chart = spec.get(2, b"")
        size = struct.unpack("<I", chart[:4])[0] if chart else 0
        self.units, self.outputs = struct.unpack(f"<{size // 4}I", chart[4 : 4 + size]), chart[4 + size :]

    def _match(self, data: bytes, at: int) -> tuple[int, int]:
        """(length, place of the output) of the longest entry of the character map that data has at a place."""
        units, best = self.units, (0, 0)
        # a unit of the double array: a label, whether an entry ends here, and an offset to the next units
        node = (units[0] >> 10) << ((units[0] & 512) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units) or units[node] & 0x800000FF != data[k]:
                break
            unit = units[node]
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                best = k + 1 - at, units[node] & 0x7FFFFFFF
        return best

    def mapped(self, text: str) -> str:
        """The output of the character map."""
        if not self.units:
            return text
        data, out, at = text.encode("utf-8", "surrogatepass"), bytearray(), 0
        while at < len(data):
            n, place = self._match(data, at)
            if n:
                out += self.outputs[place : self.outputs.index(0, place)]
            else:
                n = 1
                while at + n < len(data) and data[at + n] & 0xC0 == 0x80:
                    n += 1
                out += data[at : at + n]
            at += n
        return out.decode("utf-8", "surrogatepass")

    def run(self, text: str, state: int = START) -> tuple[str, int]:
        """What the machine writes over text, and the state that it ends in. Its arcs are taken for whole runs of characters."""
        text = self.mapped(text)
        prefix = self.space if self.dummy_prefix else ""
        if not self.squeeze:
            return (prefix if state == self.START and text else "") + text.replace(" ", self.space), self.INSIDE if text else state
        out: list[str] = []
        for part in _RUNS.findall(text):
            if part[0] != " ":
                out += ((prefix, "", self.space)[state], part)
                state = self.INSIDE
            elif state == self.INSIDE:
                state = self.GAP
        return "".join(out), state

    def whole(self, text: str) -> str:
        """The output for a whole text: the library also drops signs for a space that end it."""
        out = self.run(text)[0]
        return out.rstrip(self.space) if self.squeeze else out


class Transducers:
    """The compiled machines of a model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normaliser = {}, {}
        for number, value in model:
            if number == 1:
                p = dict(_fields(value))
                self.pieces.append((p.get(1, b"").decode(), p.get(2, 0.0), p.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        self.merges = trainer.get(3, 1) == 2
        if not self.merges and trainer.get(3, 1) != 1:
            raise ValueError("models of words or characters have no pieces to compose")
        self.normaliser = Normaliser(normaliser)
        self.dummy_prefix, self.escape = self.normaliser.dummy_prefix, self.normaliser.escape
        self.ids = {p: k for k, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        self.score = {p: s for p, s, kind in self.pieces if kind in (NORMAL, USER)}
        self.byte_ids = {int(p[3:5], 16): k for k, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.byte_of = {k: b for b, k in self.byte_ids.items()}
        self.outputs = [
            bytes([self.byte_of[k]]) if k in self.byte_of else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else (p.replace(SPACE, " ") if self.escape else p).encode()
            for k, (p, _, kind) in enumerate(self.pieces)
        ]
        self.unknown = next((k for k, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN), 0)
        plain = [np.float32(x) for _, x, kind in self.pieces if kind == NORMAL] or [np.float32(0)]
        # as in the library: a character that is no piece costs more than any piece, a user's piece less
        self.unknown_score = min(plain) - np.float32(10)
        self.user_score = {p: np.float32(len(p.encode()) * max(plain) - np.float32(0.1)) for p, _, kind in self.pieces if kind == USER}
        # the lexicon: states are prefixes, final states are pieces
        self.trie: dict = {}
        for p in self.ids:
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
        # no piece has a space sign after another character, so paths of different words never meet
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.segments = _SEGMENTS if self.normaliser.squeeze else self._independent()
        # words of the input after others and at its begin, and words that are normalised already
        self.words = Memo(lambda word: self._ids(self.normaliser.run(word, Normaliser.INSIDE)[0]), NO_WORDS)
        self.firsts = Memo(lambda word: self._ids(self.normaliser.run(word)[0]), NO_WORDS // 8)
        self.normal = Memo(self._ids, NO_WORDS)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.sides: tuple[dict, dict] = ({}, {})

    def _independent(self) -> re.Pattern:
        """Cuts an input where no piece reaches across: before spaces, around characters that only pieces of their
        own have, and between a word and a sign that no piece has after a letter."""
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        after_letters = {b for p in self.ids for a, b in zip(p, p[1:]) if _LETTER.match(a)}
        signs = [chr(c) for c in range(128) if chr(c) != " " and not _LETTER.match(chr(c))]
        alone = "".join(re.escape(c) for c in signs if c not in joined)
        ends = "".join(re.escape(c) for c in signs if c not in after_letters)
        spaces = f" {SPACE}"
        parts = [f"[{spaces}]*[^\\W\\d_]+(?=[{spaces}{ends}]|\\Z)"] if ends else []
        parts += [f"[{alone}]"] if alone else []
        return re.compile("|".join([*parts, f"[{spaces}]*[^{spaces}{alone}]+", f"[{spaces}]+"]))

    def forget(self) -> None:
        for memo in (self.words, self.firsts, self.normal):
            memo.clear()
            memo.old = {}

    def merged(self, text: str) -> list[str]:
        """What merging yields: of all neighbours that make a piece, the leftmost best are joined first."""
        parts, score = list(text), self.score
        while True:
            best, where = -INF, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and s > best:
                    best, where = s, k
            if where < 0:
                return parts
            parts[where : where + 2] = [parts[where] + parts[where + 1]]

    def parts(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge makes this one; none for a character; itself twice if no merges make it."""
        out = self.halves.get(piece, 0)
        if out == 0:
            parts, score = list(piece), self.score
            out = None
            while len(parts) > 1:
                best, where = -INF, -1
                for k in range(len(parts) - 1):
                    s = score.get(parts[k] + parts[k + 1])
                    if s is not None and s > best:
                        best, where = s, k
                if where < 0:
                    out = (piece, piece)
                    break
                out = (parts[where], parts[where + 1])
                parts[where : where + 2] = [parts[where] + parts[where + 1]]
            self.halves[piece] = out
        return out

    def side(self, piece: str, which: int) -> list[tuple[str, float]] | None:
        """What stands at one end of a piece while it is merged: (text, score of the merge that takes it in), from
        the character on. None if the piece isn't made in falling order of scores."""
        out = self.sides[which].get(piece, 0)
        if out == 0:
            out, taken, p = [], -INF, piece
            while True:
                out.append((p, taken))
                halves = self.parts(p)
                if halves is None:
                    out.reverse()
                    break
                formed = self.score.get(p, -INF)
                if halves[0] == p or any(len(h) > 1 and not self.score[h] > formed for h in halves):
                    out = None
                    break
                taken, p = formed, halves[which]
            self.sides[which][piece] = out
        return out

    def _compatible(self, a: str, b: str) -> bool:
        """Follows the two ends that meet between a and b through their merges: the pieces stay apart unless, at some
        moment, joining the ends comes before what would change either of them."""
        left, right = self.side(a, 1), self.side(b, 0)
        if left is not None and right is not None:
            i = j = 0
            while True:
                (x, x_taken), (y, y_taken) = left[i], right[j]
                s, next_ = self.score.get(x + y), x_taken if x_taken > y_taken else y_taken
                if s is not None and s >= next_:
                    if s > next_:
                        return False
                    break  # equal scores are decided by position
                if next_ == -INF:
                    return True
                if x_taken == y_taken:
                    break
                if x_taken > y_taken:
                    i += 1
                else:
                    j += 1
        return self.merged(a + b) == [a, b]

    def may_follow(self, a: str, b: str) -> bool:
        """The acceptor's arc from a to b, made when first asked for."""
        out = self.pairs.get((a, b))
        if out is None:
            if len(self.pairs) >= NO_PAIRS:
                self.pairs.clear()
            out = self.pairs[a, b] = self._compatible(a, b)
        return out

    def arcs(self, text: str, at: int) -> list[str]:
        """Pieces that start here, and the single character, which has its bytes or the unknown piece if it isn't one."""
        out, node, c = [text[at]], self.trie, at
        while c < len(text) and (node := node.get(text[c])) is not None:
            c += 1
            if "" in node and c - at > 1:
                out.append(node[""])
        return out

    def path(self, text: str) -> list[str]:
        """The shortest path over a normalised text."""
        return self._with_acceptor(text) if self.merges else self._by_weight(text)

    def _with_acceptor(self, text: str) -> list[str]:
        """The shortest path where pieces weigh nothing and the acceptor's arcs 0 or, where they are absent, infinity.

        All paths of finite weight weigh 0, so an agenda ordered by weight is a stack and the first
        path that arrives is the shortest. Its top is the longest arc. An arc of the lexicon is
        composed with the acceptor when it is taken. Only one path of finite weight leads to any place
        (what merging makes of the text up to there), so a place that was left in vain isn't entered again.
        """
        n, trie, pairs, compatible = len(text), self.trie, self.pairs, self.may_follow
        out: list[str] = []
        dead = bytearray(n + 1)
        choices: list[list[str]] = []
        at, last, options = 0, "", None
        while at < n:
            if options is None:
                # pieces that start here, the longest last, as arcs() gives them
                options, node, single = [text[at]], trie, True
                for c in text[at:]:
                    node = node.get(c)
                    if node is None:
                        break
                    if single:
                        single = False
                    elif "" in node:
                        options.append(node[""])
            while options:
                piece = options.pop()
                to = at + len(piece)
                if dead[to]:
                    continue
                if last:
                    ok = pairs.get((last, piece))
                    if ok is None:
                        ok = compatible(last, piece)
                else:
                    ok = self.parts(piece) != (piece, piece)
                if ok:
                    out.append(piece)
                    choices.append(options)
                    at, last, options = to, piece, None
                    break
            else:
                dead[at] = 1
                at -= len(out.pop())
                last, options = out[-1] if out else "", choices.pop()
        return out

    def _by_weight(self, text: str) -> list[str]:
        """The shortest path where pieces have weights: arcs are relaxed place by place, in single precision as in the library."""
        n, score, user = len(text), self.score, self.user_score
        best: list[tuple[float, str]] = [(np.float32(0), "")] + [(np.float32(INF), "")] * n
        for at in range(n):
            total = best[at][0]
            for piece in self.arcs(text, at):
                own = user[piece] if piece in user else np.float32(score[piece]) if piece in score else self.unknown_score
                weight = -(np.float32(own - total))
                if weight < best[at + len(piece)][0]:
                    best[at + len(piece)] = (weight, piece)
        out, at = [], n
        while at:
            out.append(best[at][1])
            at -= len(best[at][1])
        return out[::-1]

    def _ids(self, text: str) -> bytes:
        ids: list[int] = []
        for piece in self.path(text):
            if (k := self.ids.get(piece)) is not None:
                ids.append(k)
            elif self.byte_ids:
                ids.extend(self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass"))
            else:
                ids.append(self.unknown)
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        if self.normaliser.squeeze and not self.normaliser.units:
            text = text.rstrip(" " + self.normaliser.space)
        if not text:
            return b""
        if self.by_word and not self.normaliser.units:
            # spaces begin words, so each word is composed by itself from the state that the one before leaves
            first, *others = self.segments.findall(text)
            words = self.words
            out = self.firsts[first] + b"".join([words[w] for w in others])
        else:
            text = self.normaliser.whole(text)
            normal = self.normal
            out = b"".join([normal[w] for w in (_WORDS.findall(text) if self.by_word else [text])])
        if not self.byte_ids:
            # a run of unknown characters is one unknown piece
            ids = np.frombuffer(out, np.uint32)
            out = ids[~((ids == self.unknown) & (np.concatenate(([0], ids[:-1])) == self.unknown) & (np.arange(len(ids)) > 0))].tobytes()
        return out

    def decode(self, ids: bytes) -> str:
        """The inverse machine: pieces to characters, byte pieces to bytes, without the dummy prefix."""
        numbers = array("I", ids)
        if numbers and not self.normaliser.squeeze and self.pieces[numbers[0]][2] != CONTROL:
            # pieces are whole characters, so if all bytes together are a text, each run of byte pieces is
            outputs = self.outputs
            data = b"".join([outputs[k] for k in numbers])
            if self.dummy_prefix and self.escape and numbers[0] not in self.byte_of and data.startswith(b" ") and self.pieces[numbers[0]][2] != UNKNOWN:
                data = data[1:]
            try:
                return data.decode()
            except UnicodeDecodeError:
                pass
        out: list[str] = []
        held = bytearray()
        first = True

        def flush() -> None:
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()

        for k in numbers:
            if (b := self.byte_of.get(k)) is not None:
                held.append(b)
                first = False
                continue
            flush()
            piece, _, kind = self.pieces[k]
            if kind == CONTROL:
                continue
            if kind == UNKNOWN:
                piece = " ⁇ "
            elif self.escape:
                if first and (self.dummy_prefix or self.normaliser.squeeze) and piece.startswith(SPACE):
                    piece = piece[1:]
                    # where the normaliser drops spaces at the begin, so does its inverse
                    first = self.normaliser.squeeze and not piece
                else:
                    first = False
                piece = piece.replace(SPACE, " ")
            first = first and not piece
            out.append(piece)
        flush()
        return "".join(out)


_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_LETTER = re.compile(r"[^\W\d_]")
#: The same in an input, where the sign for a space may stand itself.
_SEGMENTS = re.compile(f"[ {SPACE}]*[^ {SPACE}]+|[ {SPACE}]+")


def _utf8(data: bytes) -> str:
    """Bytes as text; each byte that belongs to no character becomes a replacement character."""
    out, at = [], 0
    while at < len(data):
        for n in range(4, 0, -1):
            try:
                out.append(data[at : at + n].decode())
                at += len(data[at : at + n])
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_LOADED: dict[str, Transducers] = {}


def load(path: str) -> Transducers:
    """One set of machines for each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Transducers(path)
    return _LOADED[path]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary, decoded): ids are little-endian unsigned 32-bit; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = load(model)
        for batch in batches:
            ids = [machines.encode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(ids, pa.binary()), pa.array([machines.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"]
            )
        machines.forget()

    return id_and_text(docs, id_col, text_col).mapInArrow(tidily(run), "doc_id bigint, ids binary, decoded string")
