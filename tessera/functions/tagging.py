"""Words of many rule lists found in one pass over a text, as a bit for each list."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import LIST_HEADERS, META_NOISE, RuleSet

#: Signs that a matching key leaves out.
_LEFT_OUT = {ord(c): None for c in " \n\r\t-_:：.,，;；/·ㆍ[](){}"}


def key_of(word: str) -> str:
    return word.lower().translate(_LEFT_OUT)


class WordTags:
    """Lists of words by name, at most 63, as bits; the words of `counted` lists are also counted, each entry for itself."""

    def __init__(self, lists: dict[str, tuple[str, ...]], counted: dict[str, tuple[str, ...]]):
        self.bits = {name: 1 << i for i, name in enumerate(lists)}
        self.counters = tuple(counted)
        found: dict[str, list] = {}
        for name, words in lists.items():
            for key in filter(None, map(key_of, words)):
                found.setdefault(key, [0, [0] * len(counted)])[0] |= self.bits[name]
        for i, words in enumerate(counted.values()):
            for key in filter(None, map(key_of, words)):
                found.setdefault(key, [0, [0] * len(counted)])[1][i] += 1
        #: By key: a bit of its own, the bits of the lists that it stands in, and how often it counts for each counter.
        self.words = {key: (1 << i, bits, tuple(times)) for i, (key, (bits, times)) in enumerate(found.items())}

    def any_of(self, mask: Column, names: tuple[str, ...]) -> Column:
        """Whether a word of any of the lists occurs."""
        return mask.bitwiseAND(F.lit(sum(self.bits[n] for n in dict.fromkeys(names)))) != 0

    def tagger(self) -> Callable[[str], tuple[int, ...]]:
        """key -> (mask, counts...), by an automaton of all words; without its library, word by word."""
        none = (0,) * len(self.counters)

        def added(met: dict) -> tuple[int, ...]:
            mask, counts = 0, none
            for _, bits, times in met.values():
                mask |= bits
                counts = tuple(map(sum, zip(counts, times)))
            return mask, *counts

        try:
            import ahocorasick
        except ImportError:
            return lambda key: added({word: told for word, told in self.words.items() if word in key})
        if not self.words:
            return lambda key: (0, *none)
        automaton = ahocorasick.Automaton()
        for word, told in self.words.items():
            automaton.add_word(word, told)
        automaton.make_automaton()
        return lambda key: added({told[0]: told for _, told in automaton.iter(key)})

    def tagged(self, df: DataFrame, key: str, keys: str | None = None) -> DataFrame:
        """df with _mask and a column _n_<name> for each counter of its column `key`, and _masks of each element of `keys`.

        Equal keys of a batch are looked at once.
        """
        names = df.columns
        at, many = names.index(key), names.index(keys) if keys else None
        new = ["_mask", *(f"_n_{n}" for n in self.counters), *["_masks"] * bool(keys)]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", _mask bigint" + "".join(f", _n_{n} int" for n in self.counters) + ", _masks array<bigint>" * bool(keys)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tag = self.tagger()
            for batch in batches:
                told: dict[str | None, tuple[int, ...]] = {None: (0,) * (1 + len(self.counters))}

                def look_up(s: str | None) -> tuple[int, ...]:
                    if s not in told:
                        told[s] = tag(s)
                    return told[s]

                own = list(zip(*map(look_up, batch.column(at).to_pylist()))) or [()] * (1 + len(self.counters))
                columns = [pa.array(own[0], pa.int64()), *(pa.array(c, pa.int32()) for c in own[1:])]
                if keys:
                    columns.append(pa.array([None if x is None else [look_up(s)[0] for s in x] for x in batch.column(many).to_pylist()], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*names, *new])

        return df.mapInArrow(run, schema)


@cache
def word_tags(rules: RuleSet) -> WordTags:
    """All word lists of the rules that predicates ask for."""
    return WordTags({n: words_of(rules, n) for n in WORD_LISTS}, {n: words_of(rules, n) for n in COUNTED})


#: The lists that a line is searched for, those that are counted, and the ones that the rules for raw text add.
WORD_LISTS = (
    "product", "capacity", "ingredients", "usage", "cautions", "effects", "effects_content", "links", "makers", "storage", "not_capacity", "usage_signals", "caution_signals", "strong_cautions",
    "not_ingredients", "meta_noise", "list_headers",
)
COUNTED = ("not_ingredients", "effects_content")
OTHERS = {"meta_noise": META_NOISE, "list_headers": LIST_HEADERS}


def words_of(rules: RuleSet, name: str) -> tuple[str, ...]:
    return OTHERS[name] if name in OTHERS else getattr(rules, name)
