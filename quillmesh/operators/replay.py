"""Replay of thousands of literal rules: one automaton of all needles goes over each text once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of the rules of one pass, which every task holds: their number, and the code points of their needles together.
PASS_RULES, PASS_CHARS = 200_000, 8_000_000


class Matcher:
    """Tells which rules match a text in lower case: those all of whose parts have a needle in it.

    parts: for each rule its parts, each a list of needles. The work for a text is one walk of the automaton, and a step for
    each part of a found needle, however many rules there are.
    """

    def __init__(self, parts: Sequence[Sequence[Sequence[str]]]):
        import ahocorasick
        import numpy as np

        held: dict[str, list[int]] = {}
        rule_of, self.need = [], np.zeros(len(parts), np.int64)
        for rule, own in enumerate(parts):
            for needles in own:
                if "" in needles:  # the empty needle is in every text
                    continue
                for x in set(needles):
                    held.setdefault(x.lower(), []).append(len(rule_of))
                rule_of.append(rule)
                self.need[rule] += 1
        self.rule_of, self.always = np.array(rule_of, np.int64), np.flatnonzero(self.need == 0)
        self.parts_of = [np.unique(x) for x in held.values()]
        self.automaton = ahocorasick.Automaton()
        for i, x in enumerate(held):
            self.automaton.add_word(x, i)
        if held:
            self.automaton.make_automaton()

    def match(self, lower: str):
        """Places of the matching rules, in order."""
        import numpy as np

        found = {i for _, i in self.automaton.iter(lower)} if self.parts_of else ()
        if not found:
            return self.always
        parts = np.unique(np.concatenate([self.parts_of[i] for i in found]))
        rules, n = np.unique(self.rule_of[parts], return_counts=True)
        hit = rules[n == self.need[rules]]
        return np.union1d(hit, self.always) if len(self.always) else hit


def _passes(rules: Sequence) -> Iterator[list]:
    held, chars = [], 0
    for rule in rules:
        if not rule.parts or not all(rule.parts):
            raise ValueError(f"rule {rule.rule_id} has a part without needles")
        size = sum(len(x) for needles in rule.parts for x in needles)
        if held and (len(held) == PASS_RULES or chars + size > PASS_CHARS):
            yield held
            held, chars = [], 0
        held.append(rule)
        chars += size
    if held:
        yield held


def matched(messages: DataFrame, rules: Sequence, others: Column | None = None) -> DataFrame:
    """(id, is_spam, rule_ids) of every row of messages(id, is_spam, text): the ids of the literal rules that match it, after
    those of the array `others` of its columns.

    Needles and texts are compared in lower case; null texts match nothing, the empty needle every other text. Rules go to the
    tasks in passes of bounded size, one after the other in the same tasks.
    """
    import pyarrow as pa

    none = F.array().cast("array<bigint>")
    rows = messages.select("id", "is_spam", F.lower("text").alias("text"), (none if others is None else others).alias("rule_ids"))
    for own in _passes(rules):
        held = messages.sparkSession.sparkContext.broadcast(([r.parts for r in own], [r.rule_id for r in own]))

        def run(batches, held=held):
            import numpy as np

            parts, ids = held.value
            matcher, ids = Matcher(parts), np.array(ids, np.int64)
            for batch in batches:
                before = batch.column("rule_ids")
                found = [ids[matcher.match(x.as_py())] if x.is_valid else ids[:0] for x in batch.column("text")]
                starts, flat = before.offsets.to_numpy(), before.values.to_numpy(zero_copy_only=False)
                both = [x for i, y in enumerate(found) for x in (flat[starts[i] : starts[i + 1]], y)]
                ends = np.cumsum([0, *(len(y) + starts[i + 1] - starts[i] for i, y in enumerate(found))]).astype(np.int32)
                merged = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(both) if both else ids[:0], pa.int64()))
                yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "is_spam": batch.column("is_spam"), "text": batch.column("text"), "rule_ids": merged})

        rows = rows.mapInArrow(run, rows.schema)
    return rows.select("id", "is_spam", "rule_ids")
