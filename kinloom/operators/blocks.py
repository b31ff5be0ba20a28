"""A user's own method for each block: a Python function in place of a Spark rule."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

from kinloom.operators.graph import samples_of
from kinloom.sources.staging import staged

#: What a function for one block is given and gives back: genotypes (a row a sample, in row order, a column a locus, missing
#: None) to a table with the columns `sample` (as in the index), `individual`, or a dictionary of such a table as
#: "assignment" and matched pairs (id1, id2) as "matched_pairs".
BlockMethod = Callable[[pd.DataFrame], "pd.DataFrame | dict"]
ALONE = "IND_001"


def _contract(found, samples: list, grp) -> tuple[pd.DataFrame, pd.DataFrame]:
    parts = found if isinstance(found, dict) else {"assignment": found}
    if not isinstance(parts.get("assignment"), pd.DataFrame) or not {"sample", "individual"} <= set(parts["assignment"].columns):
        raise ValueError(f"block {grp}: a method gives a table with the columns sample and individual, or a dictionary with one as `assignment`")
    own = parts["assignment"][["sample", "individual"]]
    if sorted(map(str, own["sample"])) != sorted(map(str, samples)):
        raise ValueError(f"block {grp}: a method names each sample of the block once")
    matched = parts.get("matched_pairs")
    matched = pd.DataFrame({"id1": [], "id2": []}) if matched is None else matched[["id1", "id2"]]
    if not set(map(str, [*matched["id1"], *matched["id2"]])) <= set(map(str, samples)):
        raise ValueError(f"block {grp}: matched pairs name samples of the block")
    return own, matched


def by_block(panel: DataFrame, method: BlockMethod) -> tuple[DataFrame, DataFrame]:
    """(assignment (grp, sample, ord, individual), matched (grp, ord1, ord2)) of a function that is called once a block.

    The function sees one block at a time, whole, in one task: that is its contract, so blocks must fit there; blocks
    run beside each other.  What it gives back is checked; its names of individuals get the block's in front; a block of
    one sample is not passed on.  Samples are told apart by their place, so names may repeat between blocks; within a
    block they must not.
    """
    of = {f.name: f.dataType.simpleString() for f in panel.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grp = pdf["grp"].iloc[0]
        place = pdf[["ord", "sample"]].drop_duplicates().sort_values("ord")
        if place["sample"].duplicated().any():
            raise ValueError(f"block {grp}: two samples have one name")
        at = dict(zip(place["sample"], place["ord"]))
        if len(place) == 1:
            own, matched = pd.DataFrame({"sample": place["sample"], "individual": [ALONE]}), pd.DataFrame({"id1": [], "id2": []})
        else:
            wide = pdf.pivot(index="sample", columns="locus", values="gt").loc[place["sample"]]
            own, matched = _contract(method(wide.astype(object).where(wide.notna(), None)), place["sample"].tolist(), grp)
        first = pd.DataFrame({"grp": grp, "sample": own["sample"], "ord": own["sample"].map(at), "individual": [f"{grp}_{i}" for i in own["individual"]], "ord1": pd.NA, "ord2": pd.NA})
        a, b = matched["id1"].map(at), matched["id2"].map(at)
        second = pd.DataFrame({"grp": grp, "sample": None, "ord": pd.NA, "individual": None, "ord1": a.where(a < b, b), "ord2": b.where(a < b, a)})
        out = pd.concat([first, second[second["ord1"] != second["ord2"]]], ignore_index=True) if len(second) else first
        return out.astype({"ord": "Int64", "ord1": "Int64", "ord2": "Int64"})

    found = staged(panel.groupBy("grp").applyInPandas(run, f"grp {of['grp']}, sample {of['sample']}, ord bigint, individual string, ord1 bigint, ord2 bigint"), "by-block")
    assignment = found.filter("individual is not null").select("grp", "sample", "ord", "individual")
    missing = samples_of(panel).select("ord").exceptAll(assignment.select("ord"))
    if missing.head(1):
        raise ValueError("a method left out samples")
    return assignment, found.filter("ord1 is not null").select("grp", "ord1", "ord2")


def block_method(method: BlockMethod):
    """A function for one block as a method of `resolve` and `identify`."""

    def run(own: DataFrame, reps: DataFrame | None, settings: dict):
        assignment, matched = by_block(own, method)
        return matched, matched, assignment

    run.__name__ = getattr(method, "__name__", "block_method")
    return run
