"""A SentencePiece vocabulary as a max-plus machine over characters.

A path is a sequence of pieces that spell the text.  Its weight is the sum of
`score(piece)` and of `pair(left, right)`, and the encoding is the heaviest path.
For a unigram model the scores are the model's and pairs weigh 0.  For a BPE model
pieces weigh 0, and a pair weighs 0 if merging the two pieces' characters gives
just these two pieces, else minus infinity: a sequence is the BPE encoding of its
text if and only if every neighbouring pair is, so one finite path is left, and
it is the encoding.  Either way a prefix of the text and an entry piece have at
most one best last piece per end position.

Spaces are written as the mark U+2581, one is put in front.  Characters outside the vocabulary are
spelled in byte pieces; so is U+2581 itself, which keeps decoding exact.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

MARK = "▁"
LITERAL_MARK = "\ud800"  # stands for U+2581 of the text; no UTF-8 text holds it
MINUS = float("-inf")
CACHED_UNITS, CACHED_CHARS, CACHED_PAIRS = 100_000, 64, 1_000_000
ID = np.int32

State = tuple[int, int]  # (characters past the cut, piece), piece < 0: a spelled character


@dataclass(frozen=True)
class Vocabulary:
    """The plain content of a model file."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]
    special: frozenset[int]
    kind: str = "bpe"

    @staticmethod
    def load(path: str, kind: str = "bpe") -> "Vocabulary":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        pieces = tuple(model.id_to_piece(i) for i in ids)
        byte_ids = tuple(model.piece_to_id(f"<0x{b:02X}>") for b in range(256))
        special = frozenset(i for i in ids if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        return Vocabulary(pieces, tuple(model.get_score(i) for i in ids), byte_ids, special, kind)


class Decoder:
    """Bytes of every piece; the mark that encoding puts in front is taken off again."""

    def __init__(self, vocabulary: Vocabulary):
        byte_of = {piece: bytes([b]) for b, piece in enumerate(vocabulary.byte_ids)}
        self.table = [
            byte_of[i] if i in byte_of else b"" if i in vocabulary.special else p.replace(MARK, " ").encode() for i, p in enumerate(vocabulary.pieces)
        ]

        self.sizes = np.array([len(b) for b in self.table])

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The texts of ids laid end to end; text k ends before ids[ends[k]]."""
        whole = b"".join(map(self.table.__getitem__, ids.tolist()))
        cuts = np.concatenate([[0], np.cumsum(self.sizes[ids])])[np.concatenate([[0], ends])].tolist()
        texts = [whole[a:b] for a, b in zip(cuts, cuts[1:])]
        return [t[1:] if t[:1] == b" " else t for t in texts]


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.bpe = vocabulary.kind == "bpe"
        self.ids = {p: i for i, p in enumerate(vocabulary.pieces) if i not in vocabulary.special}
        self.longest = max(map(len, self.ids))
        # Where no piece has a mark behind another character, a mark after one always begins a new piece.
        self.by_words = not any(MARK in p.lstrip(MARK) for p in self.ids)
        # Likewise for a closing character that no piece holds behind a letter.
        behind_letters = {p[i] for p in self.ids for i in range(1, len(p)) if p[i - 1].isalpha()}
        closing = re.escape("".join(c for c in ".,;:!?" if c not in behind_letters))
        letter = r"[^\W\d_]"
        if closing:
            self.unit_pattern = re.compile(f"{MARK}*[^{MARK}{closing}]++(?:(?<!{letter})[^{MARK}]++)?|{MARK}*[{closing}][^{MARK}]*|{MARK}+")
        else:
            self.unit_pattern = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.spelled_score = min(vocabulary.scores) - 10.0
        self.pairs: dict[int, bool] = {}
        self.units: dict[str, bytes] = {}  # ids as machine integers
        self.older: dict[str, bytes] = {}
        self.suffixes = {p[k:]: -1 for p in self.ids for k in range(1, len(p))} | self.ids

    # ---- weights -----------------------------------------------------------------

    def keeps(self, left: str, right: str) -> bool:
        """Whether merging (best pair first, leftmost of equals) leaves `left` and `right` as they are."""
        parts, ids, scores, cut = list(left + right), self.ids, self.v.scores, len(left)
        ends = list(range(1, len(parts) + 1))
        while True:
            best, at = MINUS, -1
            for i in range(len(parts) - 1):
                piece = ids.get(parts[i] + parts[i + 1])
                if piece is not None and scores[piece] > best:
                    best, at = scores[piece], i
            if at < 0:
                return len(parts) == 2
            if ends[at] == cut:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ends[at]

    def allowed(self, left: int, right: int) -> bool:
        if left < 0 or right < 0 or not self.bpe:
            return True
        known = self.pairs.get(left << 32 | right)
        if known is None:
            known = self.pairs[left << 32 | right] = self.keeps(self.v.pieces[left], self.v.pieces[right])
        return known

    def score(self, piece: int) -> float:
        return 0.0 if self.bpe else self.v.scores[piece] if piece >= 0 else self.spelled_score

    # ---- the scan ------------------------------------------------------------------

    def scan(self, text: str, start: int, entry: int | None, stop: int | None = None) -> dict[int, tuple[float, int]]:
        """Best `(weight, last piece)` of the paths from `start` to each position; `entry` is the piece that ends at `start`.

        Ends may lie up to one piece beyond `stop` (default: the end of the text), but pieces begin before it.
        """
        best: dict[int, tuple[float, int]] = {start: (0.0, entry if entry is not None else -1)}
        stop = len(text) if stop is None else stop
        for i in range(start, stop):
            here = best.get(i)
            if here is None:
                continue
            self._extend(text, i, here, best)
        return best

    def _extend(self, text: str, i: int, here: tuple[float, int], best: dict[int, tuple[float, int]]) -> None:
        ids, n = self.ids, len(text)
        for j in range(i + 1, min(n, i + self.longest) + 1):
            piece = ids.get(text[i:j])
            if piece is None:
                if j > i + 1:
                    continue
                if self._known(text[i]):
                    continue
                piece = -ord(text[i]) - 1
            if self.allowed(here[1], piece):
                weight = here[0] + self.score(piece)
                old = best.get(j)
                if old is None or weight > old[0]:
                    best[j] = (weight, piece)

    def _known(self, char: str) -> bool:
        return char in self.ids

    def size(self, piece: int) -> int:
        return 1 if piece < 0 else len(self.v.pieces[piece])

    def backtrace(self, best: dict[int, tuple[float, int]], start: int, end: int) -> list[int]:
        """The pieces from `start` to `end`, in order."""
        out = []
        while end > start:
            piece = best[end][1]
            out.append(piece)
            end -= self.size(piece)
        return out[::-1]

    def spelled(self, path: list[int]) -> list[int]:
        """Piece ids, with spelled characters as byte pieces."""
        out: list[int] = []
        for piece in path:
            if piece >= 0:
                out.append(piece)
            else:
                char = chr(-piece - 1)
                out.extend(self.v.byte_ids[b] for b in (MARK if char == LITERAL_MARK else char).encode())
        return out

    # ---- whole texts -----------------------------------------------------------------

    def unit(self, unit: str) -> tuple[int, ...]:
        """Encoding of text that begins at a certain boundary and ends at one."""
        return self.sorted_units([unit])[0]

    def sorted_units(self, units: list[str]) -> list[tuple[int, ...]]:
        """`scan` and `backtrace` of many units in sorted order.

        The best path to a position depends on the characters before it alone, so a
        unit goes on from the prefix it shares with the one before.  With weights 0
        and minus infinity the first path to a position is the only one.
        """
        if not self.bpe:
            return [tuple(self.spelled(self.backtrace(self.scan(u, 0, None), 0, len(u)))) for u in units]
        suffixes, pairs, ids, allowed = self.suffixes, self.pairs, self.ids, self.allowed
        last, size = [-1], [1]
        before, out = "", []
        for unit in units:
            n, shared = len(unit), 0
            for x, y in zip(before, unit):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], size[shared + 1 :]
            before = unit
            for j in range(shared + 1, n + 1):
                found, length = -1, 0
                for i in range(j - 1, max(-1, j - self.longest - 1), -1):
                    piece = suffixes.get(unit[i:j])
                    if piece is None:
                        break
                    if piece >= 0 and size[i]:
                        left = last[i]
                        if left >= 0:
                            fits = pairs.get(left << 32 | piece)
                            if fits is None:
                                fits = allowed(left, piece)
                            if not fits:
                                continue
                        found, length = piece, j - i
                        break
                if not length and unit[j - 1] not in ids and size[j - 1]:
                    found, length = -ord(unit[j - 1]) - 1, 1
                last.append(found)
                size.append(length)
            path, spelled = [], False
            while n > 0:
                path.append(last[n])
                spelled |= last[n] < 0
                n -= size[n]
            path.reverse()
            out.append(tuple(self.spelled(path)) if spelled else tuple(path))
        return out

    def learn(self, units) -> dict[str, bytes]:
        """The encodings of `units`, remembered in two generations so that frequent ones stay."""
        if len(self.units) >= CACHED_UNITS:
            self.older, self.units = self.units, {}
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        known = self.units
        missing = []
        for unit in set(units) - known.keys():
            ids = self.older.get(unit)
            if ids is None:
                missing.append(unit)
            else:
                known[unit] = ids
        missing.sort()
        known.update(zip(missing, (np.array(ids, ID).tobytes() for ids in self.sorted_units(missing))))
        return known

    def marked(self, text: str) -> str:
        if MARK in text:
            text = text.replace(MARK, LITERAL_MARK)
        return text.replace(" ", MARK)

    def cut(self, marked: str) -> list[str]:
        """Split at certain boundaries."""
        return self.unit_pattern.findall(marked) if self.by_words else [marked]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Units are cut and looked up together; their memory is that of the texts."""
        cuts = [self.cut(MARK + self.marked(text)) if text else [] for text in texts]
        distinct = set().union(*cuts)
        known = self.learn(distinct)
        out = [np.frombuffer(b"".join(map(known.__getitem__, units)), ID) for units in cuts]
        self.forget_long(distinct)
        return out

    def forget_long(self, units: set[str]) -> None:
        """Keep long units out of the memory, which is bounded by their number."""
        for unit in units:
            if len(unit) > CACHED_CHARS:
                self.units.pop(unit, None)

    # ---- chunks ------------------------------------------------------------------------
    #
    # A chunk is text[start:end] seen with margins of `longest` characters.  A state at a cut is the piece
    # that holds the last character before it: (characters it reaches past the cut, piece).

    def entries(self, text: str, cut: int) -> list[State]:
        """Every state possible at `cut`, from the characters around it."""
        out = []
        for begin in range(max(0, cut - self.longest), cut):
            for end in range(cut, min(len(text), begin + self.longest) + 1):
                piece = self.ids.get(text[begin:end])
                if piece is not None:
                    out.append((end - cut, piece))
        if not self._known(text[cut - 1]):
            out.append((0, -ord(text[cut - 1]) - 1))
        return out

    def boundary(self, text: str, start: int, end: int, last: bool = False) -> int | None:
        """The first (last) certain boundary inside `start < i < end`."""
        if not self.by_words:
            return None
        steps = range(end - 1, start, -1) if last else range(start + 1, end)
        return next((i for i in steps if text[i] == MARK and text[i - 1] != MARK), None)

    def exits(self, best: dict[int, tuple[float, int]], end: int) -> dict[State, float]:
        out = {}
        for j in range(end, end + self.longest):
            if j in best and j - self.size(best[j][1]) < end:
                out[j - end, best[j][1]] = best[j][0]
        return out

    def transfer(self, text: str, start: int, end: int, first: bool) -> dict[tuple[State | None, State], float]:
        """The chunk's matrix: weight of the best path between an entry state and an exit state, where there is one."""
        sources: list[State | None] = [None] if first else list(self.entries(text, start))
        out: dict[tuple[State | None, State], float] = {}
        inner, final = self.boundary(text, start, end), self.boundary(text, start, end, last=True)
        if inner is not None:
            # All paths meet at the boundaries: the matrix is a column times a row.
            tail = self.exits(self.scan(text, final, None, end), end)
            middle = 0.0 if self.bpe else self.scan(text, inner, None, final)[final][0]
            for source in sources:
                at = start + (source[0] if source else 0)
                if at > inner:
                    continue
                head = self.scan(text, at, source[1] if source else None, inner)
                if inner in head:
                    for exit_, weight in tail.items():
                        out[source, exit_] = head[inner][0] + middle + weight
            return out
        reference: dict[int, tuple[float, int]] | None = None
        for source in sources:
            at = start + (source[0] if source else 0)
            if at >= end:  # the piece reaches past the whole chunk
                if at - self.size(source[1]) < start:
                    out[source, (at - end, source[1])] = 0.0
                continue
            best = self._scan_until_met(text, at, source[1] if source else None, end, reference)
            if reference is None and len(best) > 1:
                reference = best
            for exit_, weight in self.exits(best, end).items():
                out[source, exit_] = weight
        return out

    def _scan_until_met(self, text, at, entry, end, reference):
        """`scan`, which stops where its last `longest` positions are those of `reference` and goes on with them."""
        best = {at: (0.0, entry if entry is not None else -1)}
        agree, shift = 0, None
        for i in range(at, end):
            here = best.get(i)
            if reference is not None and i > at:
                there = reference.get(i)
                if (here is None) != (there is None) or (here and here[1] != there[1]):
                    agree, shift = 0, None
                elif here:
                    step = here[0] - there[0]
                    agree = agree + 1 if shift is None or abs(step - shift) < 1e-9 else 1
                    shift = step
                else:
                    agree += 1
                if agree > self.longest and shift is not None:
                    for j, (weight, piece) in reference.items():
                        if j > i:
                            best[j] = (weight + shift, piece)
                    return best
            if here is not None:
                self._extend(text, i, here, best)
        return best

    def chunk_ids(self, text: str, start: int, end: int, entry: State | None, exit_: State) -> np.ndarray:
        """Ids of the pieces that begin in the chunk, between two known states."""
        begin = start + (entry[0] if entry else 0)
        stop = end + exit_[0]
        if begin >= end:
            return np.array([], ID)
        inner, final = self.boundary(text, start, end), self.boundary(text, start, end, last=True)
        piece = entry[1] if entry else None
        if inner is None:
            best = self.scan(text, begin, piece, end)
            return np.array(self.spelled(self.backtrace(best, begin, stop)), ID)
        head = self.spelled(self.backtrace(self.scan(text, begin, piece, inner), begin, inner))
        units = self.cut(text[inner:final])
        known = self.learn(set(units))
        body = np.frombuffer(b"".join(map(known.__getitem__, units)), ID)
        self.forget_long(set(units))
        tail = self.spelled(self.backtrace(self.scan(text, final, None, end), final, stop))
        return np.concatenate([np.array(head, ID), body, np.array(tail, ID)])


Matrix = dict[tuple[State | None, State], float]


def compose(a: Matrix, b: Matrix) -> Matrix:
    """Max-plus product; associative."""
    by_entry: dict[State | None, list[tuple[State, float]]] = {}
    for (entry, exit_), weight in b.items():
        by_entry.setdefault(entry, []).append((exit_, weight))
    out: Matrix = {}
    for (entry, middle), weight in a.items():
        for exit_, more in by_entry.get(middle, ()):
            if out.get((entry, exit_), MINUS) < weight + more:
                out[entry, exit_] = weight + more
    return out


def states(matrices: list[Matrix]) -> list[State | None]:
    """The best path's state at every cut, from the start (None) to the end.

    Products of halves are combined upwards (a reduction tree); the way down gives each cut its state.
    """
    if not matrices:
        return [None]
    levels = [matrices]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([compose(now[i], now[i + 1]) if i + 1 < len(now) else now[i] for i in range(0, len(now), 2)])
    whole = levels[-1][0]
    end = max((s for s in whole if s[0] is None and s[1][0] == 0), key=whole.get)[1]
    ends: list[tuple[State | None, State]] = [(None, end)]
    for level in levels[-2::-1]:
        wider = []
        for k, (entry, exit_) in enumerate(ends):
            left = level[2 * k]
            if 2 * k + 1 >= len(level):
                wider.append((entry, exit_))
                continue
            right = level[2 * k + 1]
            middle = max(
                (m for (e, m) in left if e == entry and (m, exit_) in right), key=lambda m: (left[entry, m] + right[m, exit_], m)
            )
            wider += [(entry, middle), (middle, exit_)]
        ends = wider
    return [None, *[exit_ for _, exit_ in ends]]
