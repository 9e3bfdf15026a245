"""Exact SentencePiece encoding of merge-type models by backtracking, and decoding.

Merging symbol pairs one by one gives the only token sequence whose adjacent tokens all
withstand re-merging. So the encoder takes longest matches from an Aho-Corasick
automaton, checks each token against the one before it by merging their joined text
again, falls back to shorter tokens and, where none fits, to the position before;
a bitfield holds the positions that failed, so that each fails once.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from itertools import chain, groupby

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import HELD, lean, small_batches

SPACE = "▁"
#: A newline, a run of spaces with the word after it, or a last run of spaces.
UNITS = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


def _one_by_one(error: UnicodeDecodeError):
    return "�", error.start + 1


codecs.register_error("foliospark.bytewise", _one_by_one)


class _Known(dict):
    """Tokens and their listing by unit. At most twice a number of short units is kept: when that many are new, the old ones go."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, unit: str) -> tuple[tuple[int, ...], str]:
        if (found := self.old.get(unit)) is None:
            tokens = tuple(self.encode(unit))
            found = (tokens, " ".join(map(str, tokens)))
        if len(unit) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[unit] = found
        return found


class PieceCodec:
    """Encodes and decodes with the pieces and scores of a model given as bytes."""

    def __init__(self, proto: bytes, most_cached: int = 400_000):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_proto=proto)
        kinds = range(model.vocab_size())
        self.pieces = [model.id_to_piece(i) for i in kinds]
        self.end = model.eos_id()
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in kinds if model.is_byte(i)}
        silent = {i for i in kinds if model.is_control(i)}
        normal = [i for i in kinds if not (i in silent or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in normal}
        self.score = {i: model.get_score(i) for i in normal}
        missing = {c for i in normal for c in self.pieces[i]} - self.ids.keys()
        if missing or len(self.bytes) != 256:
            raise ValueError("a model is needed that has bytes, and all characters of its pieces as pieces")
        runs = [i for i in normal if set(self.pieces[i]) == {SPACE} and len(self.pieces[i]) > 1]
        rest = [i for i in normal if i not in set(runs)]
        least = min((self.score[i] for i in rest if len(self.pieces[i]) > 1), default=0.0)
        #: Runs of spaces merge after everything else, and nothing but spaces joins them.
        self.runs_last = all(self.score[i] < least for i in runs) and not any(SPACE in self.pieces[i][1:] for i in rest)
        self.surface = [b"" if i in silent else bytes([int(self.pieces[i][3:5], 16)]) if model.is_byte(i) else " ⁇ ".encode() if model.is_unknown(i) else self.pieces[i].replace(SPACE, " ").encode() for i in kinds]
        self.silent = silent
        self.matches = ahocorasick.Automaton()
        for i in rest:
            if self.merge(self.pieces[i]) == [i]:
                self.matches.add_word(self.pieces[i], i)
        self.matches.make_automaton()
        self.shorter_of: dict[int, int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.known = _Known(self._unit, most_cached)
        self.most_cached = most_cached

    def merge(self, text: str) -> list[int]:
        """The definition: merge the adjacent pair of the best score, the leftmost of equals, until none is left."""
        part: list[str] = list(text)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(part) and (k := self.ids.get(both := part[i] + part[after[i]])) is not None:
                heapq.heappush(heap, (-self.score[k], i, both))

        for i in range(len(part)):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if not part[i] or (j := after[i]) >= len(part) or part[i] + part[j] != both:
                continue
            part[i], part[j], after[i] = both, "", after[j]
            if after[i] < len(part):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return list(chain.from_iterable([self.ids[p]] if p in self.ids else [self.bytes[b] for b in p.encode()] for p in part if p))

    def _shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        if (found := self.shorter_of.get(token)) is None:
            piece, found = self.pieces[token], -1
            for n in range(len(piece) - 1, 0, -1):
                if piece[:n] in self.matches:
                    found = self.matches.get(piece[:n])
                    break
            self.shorter_of[token] = found
        return found

    def _fit(self, left: int, right: int) -> bool:
        if (found := self.fits.get((left, right))) is None:
            if len(self.fits) > self.most_cached:
                self.fits.clear()
            found = self.fits[left, right] = self.merge(self.pieces[left] + self.pieces[right]) == [left, right]
        return found

    def _backtrack(self, text: str) -> list[int]:
        """Tokens of a text of known characters."""
        tokens = [token for _, token in self.matches.iter_long(text)]
        if all(map(self._fit, tokens, tokens[1:])):  # longest matches from the left already fit
            return tokens
        longest = [-1] * (len(text) + 1)
        pieces = self.pieces
        for end, token in self.matches.iter(text):
            start = end + 1 - len(pieces[token])
            if longest[start] < 0 or len(pieces[token]) > len(pieces[longest[start]]):
                longest[start] = token
        failed = bytearray(len(text) // 8 + 1)
        tokens = []
        at, token = 0, longest[0]
        while at < len(text):
            last = tokens[-1] if tokens else -1
            while token >= 0:
                end = at + len(pieces[token])
                if not failed[end >> 3] >> (end & 7) & 1 and (last < 0 or self._fit(last, token)):
                    tokens.append(token)
                    at, token = end, longest[end]
                    break
                token = self._shorter(token)
            else:
                failed[at >> 3] |= 1 << (at & 7)
                token = tokens.pop()
                at -= len(pieces[token])
        return tokens

    def _unit(self, unit: str) -> list[int]:
        body = unit.lstrip(SPACE)
        if (spaces := len(unit) - len(body)) > 1:
            if not self.runs_last:
                return self.merge(unit)
            if not body:
                return self.merge(unit)
            tail = self._unit(SPACE + body)
            if self.pieces[tail[0]] == SPACE:
                return self.merge(SPACE * spaces) + tail[1:]
            return self.merge(SPACE * (spaces - 1)) + tail
        if all(map(self.ids.__contains__, unit)):
            return self._backtrack(unit)
        out: list[int] = []
        known = ""
        for c in unit:  # an unknown character joins nothing; it becomes its bytes
            if c in self.ids:
                known += c
                continue
            out += self._backtrack(known) if known else []
            out += [self.bytes[b] for b in c.encode()]
            known = ""
        return out + (self._backtrack(known) if known else [])

    def units(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        if not text:
            return []
        return list(map(self.known.__getitem__, UNITS.findall(SPACE + text.replace(" ", SPACE))))

    def encode(self, text: str, add_end: bool = True) -> list[int]:
        out = list(chain.from_iterable(u[0] for u in self.units(text)))
        return [*out, self.end] if add_end else out

    def decode(self, tokens: list[int]) -> str:
        """Byte tokens join into characters, bad bytes become U+FFFD each, control tokens vanish but part bytes; the space put before the text goes."""
        cuts = [i for i in self.silent if i in tokens]
        if not cuts or cuts == [self.end] and tokens.index(self.end) == len(tokens) - 1:
            parts = [tokens]
        else:
            parts = [list(part) for known, part in groupby(tokens, self.silent.__contains__) if not known]
        text = "".join(b"".join(map(self.surface.__getitem__, part)).decode("utf-8", "foliospark.bytewise") for part in parts)
        first = next((t for t in tokens[:8] if t not in self.silent), None)
        if first is None:
            first = next((t for t in tokens if t not in self.silent), None)
        return text[1:] if first is not None and self.pieces[first].startswith(SPACE) else text


_CODECS: dict[tuple[int, int], PieceCodec] = {}
HELD["codecs"] = _CODECS.clear


def codec_for(proto: bytes, most_cached: int) -> PieceCodec:
    """One codec for each model and Python worker."""
    if (found := _CODECS.get(key := (hash(proto), most_cached))) is None:
        _CODECS.clear()
        found = _CODECS[key] = PieceCodec(proto, most_cached)
    return found


#: What encode_documents can add.
OUTPUTS = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "ids_sha256": T.StringType(), "decoded": T.StringType(), "decoded_sha256": T.StringType()}


def encode_documents(docs: DataFrame, model: str, text: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), add_end: bool = True, most_cached: int = 400_000) -> DataFrame:
    """Adds token ids, their decoded text and digests of both, as named in outputs.

    Null and empty texts have the end id only, and decode to the empty text. Long texts
    and words are whole: a task holds one batch of texts, bounded in bytes, and their ids.
    Repeated rows all stay, and there are no ties to break. Columns of the input with an added name
    are replaced, and all others pass through. An empty table gives an empty table.
    The model file is read by the driver; executors get its bytes. A worker keeps the
    tokens of at most twice most_cached short units."""
    import pyarrow as pa

    small_batches(docs.sparkSession)
    with open(model, "rb") as f:
        proto = f.read()
    kept = [c for c in docs.columns if c not in outputs]
    schema = T.StructType([*[docs.schema[c] for c in kept], *[T.StructField(n, OUTPUTS[n]) for n in outputs]])
    kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}

    def run(batches):
        codec = codec_for(proto, most_cached)
        end = str(codec.end)
        for batch in batches:
            columns: dict[str, list] = {n: [] for n in outputs}
            for value in batch.column(text).to_pylist():
                units = codec.units(value or "")
                ids = list(chain.from_iterable([u[0] for u in units]))
                if add_end:
                    ids.append(codec.end)
                if "n_tokens" in columns:
                    columns["n_tokens"].append(len(ids))
                if "ids" in columns:
                    columns["ids"].append(ids)
                if "ids_sha256" in columns:
                    listed = " ".join([u[1] for u in units] + [end] * add_end)
                    columns["ids_sha256"].append(hashlib.sha256(listed.encode()).hexdigest())
                if "decoded" in columns or "decoded_sha256" in columns:
                    decoded = codec.decode(ids)
                    for n, v in (("decoded", decoded), ("decoded_sha256", hashlib.sha256(decoded.encode()).hexdigest())):
                        if n in columns:
                            columns[n].append(v)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(columns[n], kinds.get(n, pa.string())) for n in outputs], names=[*kept, *outputs])

    return docs.mapInArrow(lean(run, "codecs"), schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(docs, default_model(), outputs=("n_tokens", "ids_sha256", "decoded_sha256")).drop("text")
