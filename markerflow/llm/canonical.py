"""Mapping free-entered values to a canonical list.

Method: a multi-pattern automaton over the canonical names and their aliases finds names embedded
in a cleaned value; the longest non-overlapping mention wins. Values without a clear mention go to
token-set similarity: tokens are paired with those of a name at the least total edit distance (a
shortened word is half an edit), beside the distance of the joined spellings, and the closest name
within the limit is taken unless two are equally close.

Only names that can be within the limit are compared: an index of tokens and of spellings by what is left of them without up to two letters
gives all that lie within two edits, and a name must hold a token near the value's rarest word. What words stand for
(other names of a word, words for sides, words that say nothing) is a table of its own, given by the caller.

The canonical list and the words are dimensions with a checked size; each worker indexes them once. Values are mapped
where they are, and a task remembers its distinct values in a bounded dictionary.

Defined cases: null values give no row; an empty value, a value that only names a thing outside
the list and a value equally close to two names give `unmatched`; repeated rows give repeated results; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNMATCHED = "nan"
MAX_CANONICAL = 100_000
MAX_EDITS = 2.0
MAX_SHARE = 0.5
REMEMBERED = 200_000

#: Letters of other alphabets that look like Latin ones.
LOOKALIKES = str.maketrans("авекмнорстухіјѕԁзΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "abekmhopctyxijsd3abezhikmnoptyxo")
LEET = str.maketrans("013457", "oieast")
_VERSION = re.compile(r"v\d+|\d+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def edits(a: str, b: str, limit: int = 3) -> int:
    """Insertions, deletions, changes and swaps of neighbours from a to b; limit + 1 if more.

    Columns of the usual table are bits of whole numbers: where it goes up, where down, and where the diagonal stays.
    """
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit or not a or not b:
        return min(max(len(a), len(b)), limit + 1)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, last, distance = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down, kept, before = full, 0, 0, 0
    for c in b:
        here = at.get(c, 0)
        swapped = ((~kept & here) << 1) & before
        kept = ((((here & up) + up) ^ up) | here | down | swapped) & full
        right_up, right_down = (down | ~(kept | up)) & full, kept & up
        distance += bool(right_up & last) - bool(right_down & last)
        right_up, right_down = right_up << 1 | 1, right_down << 1
        up, down, before = (right_down | ~(kept | right_up)) & full, right_up & kept & full, here
    return min(distance, limit + 1)


class NearIndex:
    """Finds the words within two edits of a word, and maybe some others."""

    PREFIX = 7

    def __init__(self, words: Iterable[str]):
        self.words = list(words)
        keys, owners = [], []
        for i, word in enumerate(self.words):
            left = self._left(word)
            keys += left
            owners += [i] * len(left)
        order = np.argsort(np.array(keys, np.uint32), kind="stable")
        self.keys, self.owners = np.array(keys, np.uint32)[order], np.array(owners, np.int64)[order]

    def _left(self, word: str) -> list[int]:
        """Hashes of the word's beginning without up to two of its letters."""
        start = word[: self.PREFIX]
        places = range(len(start))
        left = {start} | {start[:i] + start[i + 1 :] for i in places} | {start[:i] + start[i + 1 : j] + start[j + 1 :] for i, j in combinations(places, 2)}
        return [zlib.crc32(x.encode("utf-8", "replace")) for x in left]

    def near(self, word: str) -> list[str]:
        wanted = np.array(self._left(word), np.uint32)
        low, high = np.searchsorted(self.keys, wanted), np.searchsorted(self.keys, wanted, side="right")
        found = {int(i) for a, b in zip(low.tolist(), high.tolist()) for i in self.owners[a:b]}
        return [self.words[i] for i in found if abs(len(self.words[i]) - len(word)) <= 2]


def shortens(short: str, word: str) -> bool:
    """Whether `short` leaves out letters of `word` but keeps its first one and the order."""
    if not 2 <= len(short) < len(word) or short[0] != word[0]:
        return False
    rest = iter(word)
    return all(c in rest for c in short)


def clean_text(value: str) -> str:
    """Plain Latin letters, without the namespaces before the last colon."""
    folded = unicodedata.normalize("NFKC", value).rsplit(":", 1)[-1]
    plain = "".join(c for c in unicodedata.normalize("NFD", folded) if not unicodedata.combining(c))
    # Lookalikes are listed in lower case; humps of the spelling are kept by restoring the case.
    return "".join(c if c.isascii() else (c.lower().translate(LOOKALIKES).upper() if c.isupper() else c.translate(LOOKALIKES)) for c in plain)


class Words:
    """What words stand for: rows of (alias, meaning, kind), kind being `word`, `side` or `filler`.

    Sides exclude each other and must be met exactly; the longest alias of a side may have an edit. Fillers are left out.
    """

    def __init__(self, rows: Iterable[tuple[str, str | None, str]] = ()):
        self.meaning, self.fillers, self.side = {}, set(), {}
        longest: dict[str, str] = {}
        for alias, meaning, kind in sorted(rows, key=lambda r: (r[2], r[0])):
            if kind == "filler":
                self.fillers.add(alias)
            elif kind == "side":
                self.side[alias] = meaning
                longest[meaning] = max(longest.get(meaning, ""), alias, key=len)
            else:
                self.meaning[alias] = meaning
        self.longest = [(alias, side) for side, alias in longest.items()]
        self.sides = set(longest)

    def of(self, value: str) -> list[str]:
        """The lower-case words of a value, digits inside words read as letters, versions and fillers left out."""
        found = []
        for part in re.findall(r"[A-Za-z0-9]+", _HUMP.sub(" ", clean_text(value))):
            word = part.lower()
            if word in self.meaning:
                word = self.meaning[word]
            elif _VERSION.fullmatch(word) or word in self.fillers:
                continue
            else:
                word = word.translate(LEET) if any(c.isalpha() for c in word) else word
                word = self.meaning.get(word, word)
            found.append(self.side.get(word) or next((side for alias, side in self.longest if edits(word, alias, 1) <= 1), word))
        return found


class CanonicalList:
    """Canonical names with their aliases, spelling orders and descriptions, indexed for near matches."""

    def __init__(self, entries: list[tuple[str, str | None]], words: Iterable[tuple[str, str | None, str]] = ()):
        import ahocorasick

        self.names = {name for name, _ in entries}
        self.words = Words(words)
        self.variants: list[tuple[str, tuple[str, ...]]] = []
        self.sides: dict[str, list[set[str]]] = {}
        self.holding: dict[str, list[int]] = {}
        claims: dict[str, set[str]] = {}
        sets: dict[tuple[str, ...], set[str]] = {}
        for name, description in entries:
            if name == UNMATCHED:
                continue
            variants = {tuple(self.words.of(name))} | ({tuple(self.words.of(description))} if description else set())
            variants.discard(())
            for tokens in sorted(variants):
                for token in set(tokens):
                    self.holding.setdefault(token, []).append(len(self.variants))
                self.variants.append((name, tokens))
                self.sides.setdefault(name, []).append(self.words.sides & set(tokens))
                sets.setdefault(tuple(sorted(tokens)), set()).add(name)
                # A side may stand before or after the rest.
                for first in (tokens, sorted(tokens, key=self._is_side), sorted(tokens, key=self._is_no_side)):
                    claims.setdefault("".join(first), set()).add(name)
        self.of_set = {tokens: next(iter(owners)) for tokens, owners in sets.items() if len(owners) == 1}
        self.spelled = {spelling: next(iter(owners)) for spelling, owners in claims.items() if len(owners) == 1}
        self.automaton = ahocorasick.Automaton()
        for spelling, name in self.spelled.items():
            self.automaton.add_word(spelling, (len(spelling), name))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.near_tokens = NearIndex(t for t in self.holding if not self._is_side(t))
        self.near_spellings = NearIndex(self.spelled)
        #: Tokens by their first letter and another one that they hold.
        self.beginning: dict[str, list[str]] = {}
        for token in self.near_tokens.words:
            for c in set(token[1:]):
                self.beginning.setdefault(token[0] + c, []).append(token)
        self.known: dict[str, dict[str, float]] = {}

    def _is_side(self, word: str) -> bool:
        return word in self.words.sides

    def _is_no_side(self, word: str) -> bool:
        return word not in self.words.sides

    def _mentions(self, words: list[str]) -> list[tuple[int, str]]:
        """Longest non-overlapping names in the joined words that begin and end with a word, whatever the order of a name's words."""
        joined, edges = "".join(words), [0]
        for w in words:
            edges.append(edges[-1] + len(w))
        found = [(n, end + 1 - n, name) for end, (n, name) in self.automaton.iter(joined)] if len(self.automaton) else []
        places = set(edges)
        found = [f for f in found if f[1] in places and f[1] + f[0] in places]
        for i in range(len(words)):
            for j in range(i + 1, min(i + 8, len(words)) + 1):
                if name := self.of_set.get(tuple(sorted(words[i:j]))):
                    found.append((edges[j] - edges[i], edges[i], name))
        taken, out = [], []
        for n, start, name in sorted(found, key=lambda f: (-f[0], f[1])):
            if all(start >= b or start + n <= a for a, b in taken):
                taken.append((start, start + n))
                out.append((n, name))
        return out

    def _similar(self, word: str) -> dict[str, float]:
        """Tokens that a word may stand for, with how far they are from it."""
        if (found := self.known.get(word)) is not None:
            return found
        if self._is_side(word):
            found = {word: 0.0} if word in self.holding else {}
        else:
            found = {t: float(d) for t in self.near_tokens.near(word) if (d := edits(word, t, 2)) <= MAX_EDITS}
            for token in min((self.beginning.get(word[0] + c, ()) for c in word[1:]), key=len, default=()):
                if token != word and shortens(word, token):
                    found[token] = min(found.get(token, 9.0), 0.5 + 0.01 * (len(token) - len(word)))
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[word] = found
        return found

    def _candidates(self, words: list[str]) -> set[int]:
        """Every variant that can be within the limit: what a value has beyond a name is at most two letters, so each longer word
        stands for a token of the name, and the one with the fewest names tells."""
        sizes = {w: sum(len(self.holding[t]) for t in self._similar(w)) for w in set(words)}
        told = min((w for w in sizes if len(w) > MAX_EDITS), key=lambda w: (sizes[w], w), default=None)
        return {i for w in ([told] if told else sizes) for t in self._similar(w) for i in self.holding[t]}

    def _token_distance(self, words: list[str], tokens: tuple[str, ...]) -> float:
        total, left = 0.0, list(words)
        for token in sorted(tokens, key=len, reverse=True):
            best, pick = 9.0, None
            for w in left:
                if (d := self._similar(w).get(token, 9.0)) < best:
                    best, pick = d, w
            total += best
            if pick is None or total > MAX_EDITS:
                return 9.0
            left.remove(pick)
        return total + sum(map(len, left))

    def match(self, value: str) -> str:
        if value in self.names:
            return value
        words = self.words.of(value)
        joined = "".join(words)
        if not any(c.isalpha() for c in joined):
            return UNMATCHED
        mentions = self._mentions(words)
        if mentions and (len(mentions) == 1 or mentions[0][0] > mentions[1][0]):
            if 2 * mentions[0][0] >= len(joined):
                return mentions[0][1]
        limit = min(MAX_EDITS, MAX_SHARE * len(joined))
        sides = self.words.sides & set(words)
        best: dict[str, float] = {}
        for i in self._candidates(words):
            name, tokens = self.variants[i]
            best[name] = min(best.get(name, 9.0), self._token_distance(words, tokens))
        for spelling in self.near_spellings.near(joined):
            name = self.spelled[spelling]
            best[name] = min(best.get(name, 9.0), float(edits(joined, spelling, 2)))
        scored = sorted((d, name) for name, d in best.items() if d <= limit and (not sides or any(sides <= s for s in self.sides[name])))
        if not scored or (len(scored) > 1 and scored[1][0] == scored[0][0]):
            return UNMATCHED
        return scored[0][1]


def canonical_entries(canonical: DataFrame, name_col: str, description_col: str) -> list[tuple[str, str | None]]:
    """The list as rows on the driver, after a check of its size."""
    rows = canonical.where(F.col(name_col).isNotNull()).select(name_col, description_col).distinct().limit(MAX_CANONICAL + 1).collect()
    if len(rows) > MAX_CANONICAL:
        raise ValueError(f"a canonical list holds at most {MAX_CANONICAL} entries")
    return sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0], r[1] or ""))


def word_rows(words: DataFrame | None) -> list[tuple[str, str | None, str]]:
    """The table `alias, meaning, kind` on the driver, after a check of its size."""
    if words is None:
        return []
    rows = words.where("alias is not null and kind is not null").select(F.lower("alias"), F.lower("meaning"), "kind").distinct().limit(MAX_CANONICAL + 1).collect()
    if len(rows) > MAX_CANONICAL:
        raise ValueError(f"a table of words holds at most {MAX_CANONICAL} entries")
    return sorted((tuple(r) for r in rows), key=repr)


_lists: dict[int, CanonicalList] = {}


def _listed(entries: list, words: list, digest: int) -> CanonicalList:
    """The indexed list, made once in a worker."""
    if digest not in _lists:
        _lists.clear()
        _lists[digest] = CanonicalList(entries, words)
    return _lists[digest]


def map_values(
    values: DataFrame,
    canonical: DataFrame,
    value_col: str,
    out_col: str,
    name_col: str = "label",
    description_col: str = "description",
    words: DataFrame | None = None,
) -> DataFrame:
    """`values` with `out_col`: the canonical entry meant by `value_col`, or `UNMATCHED`.

    `words` has `alias, meaning, kind`, see `Words`.
    """
    if out_col in values.columns:
        raise ValueError(f"the values already have a column {out_col}")
    entries, aliases = canonical_entries(canonical, name_col, description_col), word_rows(words)
    digest = zlib.crc32(repr((entries, aliases)).encode("utf-8", "replace"))
    schema = T.StructType([*values.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known = _listed(entries, aliases, digest), {}
        for batch in batches:
            texts = batch.column(value_col).to_pylist()
            for text in set(texts) - known.keys() - {None}:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[text] = names.match(text)
            out = pa.array([None if t is None else known.get(t) or names.match(t) for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, out_col])

    return values.mapInArrow(run, schema)


def typed_labels(sessions: DataFrame, samples: DataFrame, layouts: DataFrame) -> DataFrame:
    """`field_name, record_key, marker_idx, typed`: every non-null label of sessions, samples and submitted layouts, each row once.

    The rows are few beside the work on them, so they go to a set number of partitions, by all columns: a spelling that
    most rows have is no one's burden."""

    def entries(df: DataFrame, column: str) -> DataFrame:
        exploded = df.select(F.col("seq_id").alias("record_key"), F.posexplode(column).alias("marker_idx", "typed"))
        return exploded.select(F.lit(column).alias("field_name"), "record_key", "marker_idx", "typed")

    submitted = layouts.where(~F.col("layout_id").eqNullSafe("superset")).select(
        F.lit("marker_vids").alias("field_name"), F.col("layout_id").alias("record_key"), F.col("ord").alias("marker_idx"), F.col("label").alias("typed")
    )
    rows = entries(sessions, "labels").unionByName(entries(samples, "marker_labels")).unionByName(submitted).where("typed is not null")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *rows.columns).distinct()


def canonical_labels(sessions: DataFrame, samples: DataFrame, layouts: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """`typed_labels` with `label`, the superset label meant."""
    superset = layouts.where("layout_id = 'superset'")
    return map_values(typed_labels(sessions, samples, layouts), superset, "typed", "label", words=words)


def mistyped_labels(sessions: DataFrame, samples: DataFrame, layouts: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """`field_name, record_key, marker_idx, label` of every entry that is not letter for letter a superset label."""
    mapped = canonical_labels(sessions, samples, layouts, words)
    # Only what is a superset label letter for letter is mapped to itself.
    return mapped.where("typed != label").select("field_name", "record_key", "marker_idx", "label").distinct()
