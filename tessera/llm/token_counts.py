"""Token counts by a compiled finite-state tokenizer.

A byte-fallback BPE vocabulary is compiled, state by state as texts call for it, to a deterministic
transducer over characters. Its transitions carry the change in the number of tokens emitted so far (an
added character may merge tokens, so the change can be negative). A BPE result is the one sequence of
pieces in which each adjacent pair encodes to itself; so the last piece of every prefix is determined
by the last pieces of shorter prefixes, and the state is: the longest suffix that can still grow into a
piece, and the last piece and relative count at each of its positions.

No piece continues from a non-space to a space, so the transducer returns to its start state there. The
state map of a chunk is therefore a head (to be run from whatever state comes in), a count, and the state
after its last return; maps compose associatively, and a long text's chunks are combined by a scan in
the shape of a tree. Macro-transitions from one return to the next are remembered (bounded).

Cases: null and empty texts have 0 bytes and 0 tokens; each repeated row is counted; null ids stay null;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_model

SPACE = "▁"
MAX_STATES, MAX_WORDS = 150_000, 400_000
START = ("", ((0, None, 0),))


class Transducer:
    """Deterministic transducer for one vocabulary; states are made as they are reached and forgotten together at a bound."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.scores = scores
        self.growing = {p[:k] for p in scores for k in range(1, len(p))}  # what a longer piece starts with
        for p in scores:
            if SPACE in p[1:] and p.strip(SPACE):
                raise ValueError("a piece continues from a non-space to a space")
        self.pairs: dict[tuple[str | None, str], bool] = {}
        self.made: dict[str, tuple | None] = {}  # one entry for each piece, and for each unknown character met
        self.words: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.keys, self.ids, self.next = [START], {START: 0}, [{}]

    def merges(self, piece: str) -> tuple | None:
        """How a piece comes about from its characters: (score, its first part, its last part) after each merge; None if it doesn't."""
        if piece not in self.made:
            parts, scores, out = list(piece), self.scores, [(0.0, piece[0], piece[-1])]
            while len(parts) > 1:
                found = [(s, -i) for i in range(len(parts) - 1) if (s := scores.get(parts[i] + parts[i + 1])) is not None]
                if not found:
                    break
                s, i = max(found)
                parts[-i : 2 - i] = [parts[-i] + parts[1 - i]]
                out.append((s, parts[0], parts[-1]))
            self.made[piece] = tuple(out) if len(parts) == 1 else None
        return self.made[piece]

    def fits(self, left: str | None, piece: str) -> bool:
        """Whether piece can follow left in a BPE result: both come about by themselves, and no merge across is due before either is whole."""
        key = (left, piece)
        fit = self.pairs.get(key)
        if fit is None:
            if len(self.pairs) > 300_000:
                self.pairs.clear()
            fit = self.pairs[key] = self.follows(left, piece)
        return fit

    def follows(self, left: str | None, piece: str) -> bool:
        b = self.merges(piece)
        if b is None or left is None:
            return b is not None
        a, scores, none = self.merges(left), self.scores, float("-inf")
        i = j = 0
        while True:
            across = scores.get(a[i][2] + b[j][1])
            x = a[i + 1][0] if i + 1 < len(a) else none
            y = b[j + 1][0] if j + 1 < len(b) else none
            if across is not None and across > x and across >= y:  # of equal scores the leftmost is merged first
                return False
            if x == y == none:
                return True
            if x >= y:
                i += 1
            else:
                j += 1

    def step(self, state: int, ch: str) -> tuple[int, int]:
        """A state's key: (suffix, (length, last piece, relative count)...), for each length of a suffix that a piece may start with."""
        suffix, entries = self.keys[state]
        end, scores, growing, known = len(suffix), self.scores, self.growing, self.pairs
        for length, last, before in entries:  # longest first; length 0 always fits as a last resort
            piece = suffix[end - length :] + ch
            if not length or piece in scores:
                fit = known.get((last, piece))
                if fit or (fit is None and self.fits(last, piece)):
                    break
        delta = before + (1 if piece in scores else len(piece.encode("utf-8", "surrogatepass")))
        kept = [(n + 1, p, c - delta) for n, p, c in entries if suffix[end - n :] + ch in growing]
        key = ((suffix + ch)[end + 1 - kept[0][0] :] if kept else "", (*kept, (0, piece, 0)))
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.keys)
            self.keys.append(key)
            self.next.append({})
        self.next[state][ch] = (to, delta)
        return to, delta

    def run(self, key: tuple, text: str) -> tuple[tuple, int]:
        """From a state (by its key) through text: the state after it and the tokens added."""
        if len(self.keys) > MAX_STATES:
            self.reset()
        state = self.ids.get(key)
        if state is None:
            state = self.ids[key] = len(self.keys)
            self.keys.append(key)
            self.next.append({})
        count, step = 0, self.next
        for ch in text:
            state, d = step[state].get(ch) or self.step(state, ch)
            count += d
        return self.keys[state], count

    def word(self, word: str) -> int:
        """Tokens of a space and a word without spaces: a macro-transition from the start state to itself."""
        n = self.words.get(word)
        if n is None:
            if len(self.words) >= MAX_WORDS:
                self.words.clear()
            n = self.words[word] = self.run(START, SPACE + word)[1]
        return n

    def chunk_map(self, chunk: str) -> tuple:
        """(head, count, state): head runs from what comes in; state is None without a return to the start."""
        parts = chunk.split(SPACE)
        if len(parts) < 2:
            return chunk, 0, None
        head, k = parts[0], 1
        if not head:  # spaces at the front may continue a run of spaces
            while k < len(parts) - 1 and not parts[k]:
                k += 1
            head, k = SPACE * k + parts[k], k + 1
        if k >= len(parts):
            return head, 0, None
        count, gap, known = 0, "", self.words
        for w in parts[k:-1]:
            if not w:
                gap += SPACE
            elif gap:
                count += self.run(START, gap + SPACE + w)[1]
                gap = ""
            else:
                n = known.get(w)
                count += self.word(w) if n is None else n
        return head, count, self.run(START, gap + SPACE + parts[-1])

    def compose(self, a: tuple, b: tuple) -> tuple:
        """Of the maps of two neighbouring chunks."""
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        if b[0][:1] == SPACE and a[2][0][1][-1][1] is not None and a[2][0][1][-1][1][-1] != SPACE:  # b starts with a return
            total, state = a[1] + a[2][1], self.run(START, b[0])
        else:
            key, n = self.run(a[2][0], b[0])
            total, state = a[1], (key, a[2][1] + n)
        return (a[0], total, state) if b[2] is None else (a[0], total + state[1] + b[1], b[2])

    def count(self, text: str, chunk: int = 1 << 16) -> int:
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        maps = [self.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, count, state = maps[0]
        return self.run(START, head)[1] + count + (state[1] if state else 0)


def load_vocabulary(path: str) -> dict[str, float]:
    """Pieces and scores of a sentencepiece BPE model with byte fallback, a dummy prefix and no other normalisation."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    if [sp.encode(" a  b\n", out_type=str), sp.encode("ﬁ", out_type=str)] != [sp.encode(" a  b\n", out_type=str), ["▁", "<0xEF>", "<0xAC>", "<0x81>"]] and "ﬁ" not in "".join(sp.encode("ﬁ", out_type=str)):
        raise ValueError("the model normalises its input")
    return {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}


def count_tokens(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of each row. model_path is read on the executors (the vocabulary is part of an installed library)."""
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = src.schema["id"].dataType

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = worker_model(f"tokens {model_path}", lambda: Transducer(load_vocabulary(model_path)))
        for b in batches:
            n = [t.count(x.as_py()) for x in b.column(1)]
            size = pa.compute.binary_length(b.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    import pyarrow.compute  # noqa: F401

    out = src.mapInArrow(counted, f"id {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
