"""An invented rule set in the published shape: three criterion tiers, then a count of factors."""

from __future__ import annotations

from refledger.operators.rules import Criterion, Factor, RuleSet, Tier

RULES = RuleSet(
    tiers=(
        Tier("a", 1, "first tier"),
        Tier("b", 2, "second tier"),
        Tier("c", 3, "third tier"),
        Tier("many", 4, "fourth tier", "two factors or more"),
        Tier("one", 5, "fifth tier", "one factor"),
        Tier("none", 6, "last tier", "no factor"),
    ),
    criteria=(
        Criterion("a-1-1", "a", "a-1", "(1) finding with any of:", "finding", "first event"),
        Criterion("a-1-2", "a", "a-1", "(1) finding with any of:", "finding", "second event"),
        Criterion("a-2-1", "a", "a-2", "(2) record, with:", "record", "third event"),
        # The same fact as the prerequisite of a-1.
        Criterion("a-3", "a", None, None, None, "finding。"),
        Criterion("b-1", "b", None, None, None, "condition one"),
        Criterion("b-2", "b", None, None, None, "condition two"),
        Criterion("c-1", "c", None, None, None, "condition three"),
        Criterion("c-2", "c", None, None, None, "measure at or over the limit"),
    ),
    factors=(
        Factor("f-1", "factor one"),
        Factor("f-2", "factor two"),
        Factor("f-3", "factor three"),
        Factor("f-4", "two of these parts", None, 2),
        Factor("f-4-1", "part one", "f-4"),
        Factor("f-4-2", "part two", "f-4"),
        Factor("f-4-3", "part three", "f-4"),
    ),
    criterion_tiers=("a", "b", "c"),
    measure=("c-2", 200),
    breaks=((2, "many"), (1, "one"), (0, "none")),
)
