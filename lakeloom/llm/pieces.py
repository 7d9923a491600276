"""SentencePiece encoding and decoding by a table of the last token of each prefix.

Merging always takes the pair of neighbours whose concatenation has the highest score, the leftmost of equal ones. So the
tokens of a prefix are those of the text as far as they go, and a sequence of tokens is the encoding of its text if and
only if each two neighbours stay as they are when they are merged alone. Each prefix has therefore one last token: of the
tokens that end there, which an Aho-Corasick automaton finds, the one that is compatible with the last token of the prefix
before it. The table is filled from left to right, and tokens are read off backwards.

The vocabulary is read on the driver and broadcast; it has the size of the model file. Texts are cut where no piece has
the two characters beside each other, so most cuts are words, and equal words of a batch are encoded once.
"""

from __future__ import annotations

import gc
import re
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lakeloom.llm.common import free, table

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = range(4)
#: Words that a worker keeps encoded, up to twice as many, and the longest of them.
KEPT, SHORT = 250_000, 48
#: Pairs of tokens whose compatibility a worker remembers.
PAIRS = 1_000_000
#: Words of a text that are looked up at a time.
BLOCK = 100_000
#: Characters of a text that is looked up at once.
LONG = 1_000_000
#: What stands before the first token.
START = -(1 << 21)


def vocabulary(model_file: str) -> dict:
    """Pieces, scores and kinds of a BPE model with byte fallback, whose pieces are made of pieces of one character and
    whose normalisation only marks blanks; others are an error."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = model.get_piece_size()
    kinds = [CONTROL if model.is_control(i) else UNKNOWN if model.is_unknown(i) else BYTE if model.is_byte(i) else NORMAL for i in range(n)]
    out = {"pieces": [model.id_to_piece(i) for i in range(n)], "scores": [model.get_score(i) for i in range(n)], "kinds": kinds}
    normal = {p for p, k in zip(out["pieces"], kinds) if k == NORMAL}
    plain = not any(model.is_unused(i) for i in range(n)) and kinds.count(BYTE) == 256 and normal.issuperset("".join(normal))
    for text in ("", "  a ééＡﬁ  b\n", "x"):  # neither folded, trimmed nor composed
        plain = plain and model.decode(model.encode(text)) == text and model.normalize(text) == (SPACE + text.replace(" ", SPACE) if text else "")
    if not plain:
        raise ValueError("a BPE model with byte fallback, blanks marked at the front and no other normalisation is needed")
    return out


class Encoder:
    """The automaton, what pairs of tokens are compatible, and words that were encoded before."""

    def __init__(self, vocabulary: dict):
        import ahocorasick

        self.pieces, kinds = vocabulary["pieces"], vocabulary["kinds"]
        self.ids = {p: i for i, p in enumerate(self.pieces) if kinds[i] == NORMAL}
        self.score = {p: vocabulary["scores"][i] for p, i in self.ids.items()}
        self.bytes = [0] * 256
        for i, p in enumerate(self.pieces):
            if kinds[i] == BYTE:
                self.bytes[int(p[3:5], 16)] = i
        self.alone, self.words, self.before, self.known = {}, {}, {}, 0
        self.sizes = [len(p) for p in self.pieces]
        #: By token: whether it may follow a token, which is START at the front of a text and -1 less its code point for a
        #: character that is no piece.
        self.after: list[dict[int, bool]] = [{START: True} for _ in self.pieces]
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if self.history(p):
                self.automaton.add_word(p, (len(p), i, self.after[i]))
        self.automaton.make_automaton()
        self.letters = frozenset(p for p in self.ids if len(p) == 1)
        inside = {c for p in self.ids if len(p) > 1 for c in p}
        lone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in inside)
        crossed = any(a != SPACE and b == SPACE for p in self.ids for a, b in zip(p, p[1:]))
        own = f"[{lone}]+" if lone else "(?!)"
        self.cuts = re.compile(f"[^{lone}]+|{own}" if crossed else f"{SPACE}*[^{SPACE}{lone}]+|{SPACE}+|{own}")

    def history(self, token: str) -> list[tuple[str, str, float | None]]:
        """The token's own merges: its first and last symbol before each and the score of that merge, none at the end; empty
        for a token whose own text is encoded otherwise."""
        if token not in self.alone:
            symbols, steps, score = list(token), [], self.score
            while True:
                best = max(((score[a + b], -k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in score), default=None)
                steps.append((symbols[0], symbols[-1], best and best[0]))
                if best is None:
                    break
                k = -best[1]
                symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            if len(token) == 1 and token not in score:
                return steps
            self.alone[token] = steps if len(symbols) == 1 else []
        return self.alone[token]

    def text_of(self, i: int) -> str:
        return self.pieces[i] if i >= 0 else chr(-1 - i)

    def compatible(self, a: int, b: int) -> bool:
        """Merging the text of both never merges across: what either would merge next comes first, the left of equals."""
        left, right, i, j = self.history(self.text_of(a)), self.history(self.text_of(b)), 0, 0
        while True:
            across, one, two = self.score.get(left[i][1] + right[j][0]), left[i][2], right[j][2]
            if across is not None and (one is None or across > one) and (two is None or across >= two):
                return False
            if one is None and two is None:
                return True
            if two is None or (one is not None and one >= two):
                i += 1
            else:
                j += 1

    def remembered(self, a: int, b: int) -> bool:
        if self.known > PAIRS:
            for x in self.after:
                x.clear()
                x[START] = True
            self.known = 0
        self.known += 1
        self.after[b][a] = out = self.compatible(a, b)
        return out

    def encoded(self, text: str) -> tuple[int, ...]:
        """Ids of a text whose blanks are marked."""
        last = [0] * (len(text) + 1)  # the last token of each prefix
        last[0] = START
        if not self.letters.issuperset(text):  # characters that are no piece stand alone
            for k, c in enumerate(text):
                if c not in self.letters:
                    last[k + 1] = -1 - ord(c)
        for end, (size, i, after) in self.automaton.iter(text):
            if not last[end + 1]:
                before = last[end + 1 - size]
                fits = after.get(before)
                if fits or (fits is None and self.remembered(before, i)):
                    last[end + 1] = i
        out, at, sizes = [], len(text), self.sizes
        while at:
            i = last[at]
            if i >= 0:
                out.append(i)
                at -= sizes[i]
            else:
                out += [self.bytes[b] for b in reversed(chr(-1 - i).encode())]
                at -= 1
        out.reverse()
        return tuple(out)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; none of an empty one."""
        if not text:
            return np.zeros(0, np.int32)
        marked, out = SPACE + text.replace(" ", SPACE), []
        if len(marked) <= LONG:
            blocks = iter([self.cuts.findall(marked)])
        else:
            cuts = (m.group() for m in self.cuts.finditer(marked))
            blocks = iter(lambda: list(islice(cuts, BLOCK)), [])
        for words in blocks:
            if len(self.words) > KEPT:  # words that were met since the last time stay
                self.words, self.before = {}, self.words
            known, before, here = self.words, self.before, {}
            for w in set(words).difference(known):
                (known if len(w) <= SHORT else here)[w] = before.get(w) or self.encoded(w)
            if here:
                known = here | {w: known[w] for w in set(words).difference(here)}
            out.append(np.fromiter(chain.from_iterable(map(known.__getitem__, words)), np.int32))
        return np.concatenate(out)


class Decoder:
    """The text of ids: blanks marked at the front of the first piece go, byte tokens are read as UTF-8."""

    def __init__(self, vocabulary: dict):
        self.kinds, self.marked = vocabulary["kinds"], [p.startswith(SPACE) for p in vocabulary["pieces"]]
        plain = {CONTROL: lambda p: b"", UNKNOWN: lambda p: " ⁇ ".encode(), BYTE: lambda p: bytes([int(p[3:5], 16)]), NORMAL: lambda p: p.replace(SPACE, " ").encode()}
        self.bytes = [plain[k](p) for p, k in zip(vocabulary["pieces"], self.kinds)]
        self.control = frozenset(i for i, k in enumerate(self.kinds) if k == CONTROL)

    def decode(self, ids: list[int]) -> str:
        first = next((k for k, i in enumerate(ids) if self.kinds[i] != CONTROL), None)
        if first is None:
            return ""
        parts = list(map(self.bytes.__getitem__, ids))
        if self.kinds[ids[first]] == NORMAL and self.marked[ids[first]]:
            parts[first] = parts[first][1:]
        if self.control.isdisjoint(ids):  # one between byte tokens ends their run
            try:
                return b"".join(parts).decode()
            except UnicodeDecodeError:
                pass
        return "".join(self.lenient(ids, parts))

    def lenient(self, ids: list[int], parts: list[bytes]):
        """Bytes that are no UTF-8 become U+FFFD one by one, in each run of byte tokens."""
        k = 0
        while k < len(ids):
            if self.kinds[ids[k]] != BYTE:
                yield parts[k].decode()
                k += 1
                continue
            run = b""
            while k < len(ids) and self.kinds[ids[k]] == BYTE:
                run += parts[k]
                k += 1
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        yield run[at : at + size].decode()
                        at += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    yield "�"
                    at += 1


def per_worker(kind, shared):
    """One encoder or decoder for all tasks of a worker: it is kept beside the vocabulary that was broadcast to it."""

    def get():
        held = shared.value.setdefault("held", {})
        if kind.__name__ not in held:
            held[kind.__name__] = kind(shared.value)
            gc.freeze()  # the tables hold no garbage and need not be searched for it
        return held[kind.__name__]

    return get


def encoded_rows(e: Encoder, texts: pa.Array) -> tuple[list[np.ndarray], pa.ListArray]:
    ids = [e.encode(t or "") for t in texts.to_pylist()]
    ends = np.cumsum([0, *map(len, ids)])
    return ids, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]), pa.int32()))


def encoder(spark: SparkSession, model_file: str):
    """Column of texts -> column of ids. A null text has none, like an empty one."""
    get = per_worker(Encoder, spark.sparkContext.broadcast(vocabulary(model_file)))

    @arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return encoded_rows(get(), texts)[1]

    return encode


def decoder(spark: SparkSession, model_file: str):
    """Column of ids -> column of texts. Null ids are an empty text; ids that the model lacks are an error."""
    get = per_worker(Decoder, spark.sparkContext.broadcast(vocabulary(model_file)))

    @arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        d = get()
        return pa.array([d.decode(i or []) for i in ids.to_pylist()], pa.string())

    return decode


def tokenised(docs: DataFrame, model_file: str, *, text_col: str = "text") -> DataFrame:
    """The input's rows and columns with ids (array<int>) and decoded (string); columns of these names are replaced.

    Whole texts are encoded, without begin or end ids. A null or empty text has no ids and decodes to an empty text. Long
    texts are encoded in blocks, a text of any length in time that grows with it. Rows that repeat are each encoded; an
    empty table gives an empty table. A text decodes to itself, but that the sign of marked blanks becomes a blank.
    """
    spark, (both,) = docs.sparkSession, free([*docs.columns, "ids", "decoded"], "encoded")
    shared = spark.sparkContext.broadcast(vocabulary(model_file))
    to_ids, to_text = per_worker(Encoder, shared), per_worker(Decoder, shared)

    @arrow_udf("struct<ids: array<int>, decoded: string>")  # in one, so that ids are decoded where they were made
    def there_and_back(texts: pa.Array) -> pa.Array:
        d = to_text()
        ids, column = encoded_rows(to_ids(), texts)
        return pa.StructArray.from_arrays([column, pa.array([d.decode(i.tolist()) for i in ids], pa.string())], ["ids", "decoded"])

    out = docs.withColumn(both, there_and_back(F.col(text_col)))
    return out.withColumns({c: F.col(both)[c] for c in ("ids", "decoded")}).drop(both)


def digest(ids: Column) -> Column:
    """SHA-256 of decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = tokenised(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.col("ids")).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
