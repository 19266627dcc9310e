"""Template tables: descriptors under a contract that travels with the column, content hashes, checks, and reuse of what is built."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "descriptor_contract"
STORED = {"float": "float32", "binary": "packed_uint8"}  # fixed values


@dataclass(frozen=True)
class Contract:
    """What a column of descriptors holds: two columns can be compared only under equal contracts."""

    kind: str = "float"
    metric: str = "l2"
    dimension: int = 128
    storage: str = "float32"
    bitorder: str = ""
    transform_name: str = "identity"
    transform_id: str = ""

    def __post_init__(self) -> None:
        if self.kind not in STORED or self.storage != STORED[self.kind]:
            raise ValueError(f"{self.kind} descriptors stored as {self.storage}")
        if self.metric != ("l2" if self.kind == "float" else "hamming"):
            raise ValueError(f"{self.kind} descriptors compared by {self.metric}")
        if self.dimension < 1 or (self.kind == "binary" and (self.dimension % 8 or self.bitorder not in ("little", "big"))):
            raise ValueError("binary descriptors need whole bytes and a bit order")

    @property
    def width(self) -> int:
        """Numbers of a stored descriptor."""
        return self.dimension // 8 if self.kind == "binary" else self.dimension


def with_contract(df: DataFrame, contract: Contract, column: str = "descriptors") -> DataFrame:
    """df whose column says what it holds; parquet keeps it."""
    return df.withMetadata(column, {KEY: json.dumps(asdict(contract), sort_keys=True)})


def contract_of(df: DataFrame, column: str = "descriptors") -> Contract:
    """What the column says it holds; ValueError if it says nothing, or something else than contracts hold."""
    found = df.schema[column].metadata.get(KEY)
    if found is None:
        raise ValueError(f"column {column} has no contract")
    held = json.loads(found)
    if held.keys() != asdict(Contract()).keys():
        raise ValueError(f"the contract of column {column} has other fields: {sorted(held)}")
    return Contract(**held)


def comparable(a: DataFrame, b: DataFrame, column: str = "descriptors") -> Contract:
    """The contract of both; ValueError names the fields that differ."""
    one, two = asdict(contract_of(a, column)), asdict(contract_of(b, column))
    if differ := [k for k in one if one[k] != two[k]]:
        raise ValueError("descriptors can't be compared: " + ", ".join(f"{k} is {one[k]!r} and {two[k]!r}" for k in differ))
    return Contract(**one)


def content_hash(*parts: Column) -> Column:
    """A hash of what a template holds, not of its names: equal arrays, equal hash. Null parts differ from empty ones."""
    shown = [F.coalesce(F.concat(F.lit("["), F.array_join(p.cast("array<string>"), ",", "null"), F.lit("]")), F.lit("null")) for p in parts]
    return F.sha2(F.concat_ws("|", *shown), 256)


def problems(templates: DataFrame, contract: Contract) -> DataFrame:
    """(identity, image, problem) of each template (identity, image, points, descriptors) that can't be used, by the first rule that it
    fails: no points, not a descriptor for each point, descriptors of another width or holding a null."""
    rules = [
        (F.coalesce(F.size("points"), F.lit(-1)) <= 0, "no_keypoints"),
        (F.coalesce(F.size("descriptors"), F.lit(-1)) != F.size("points"), "descriptor_count_differs"),
        (F.exists("descriptors", lambda d: F.coalesce(F.size(d), F.lit(-1)) != contract.width), "descriptor_width_differs"),
        (F.exists("descriptors", lambda d: F.exists(d, lambda x: x.isNull())), "descriptor_holds_null"),
    ]
    return templates.select("identity", "image", F.coalesce(*[F.when(rule, name) for rule, name in rules]).alias("problem")).where("problem is not null")


def to_build(images: DataFrame, templates: DataFrame) -> DataFrame:
    """The images (identity, image, hash) that no template of the same identity, image and content hash stands for; null hashes are always built."""
    return images.join(templates.select("identity", "image", "hash"), ["identity", "image", "hash"], "left_anti")


def identity_templates(templates: DataFrame) -> DataFrame:
    """(identity, images, num_templates): each identity's template images in order, each once; an identity enrols a bounded number."""
    return templates.where("identity is not null and image is not null").groupBy("identity").agg(F.sort_array(F.collect_set("image")).alias("images")).withColumn("num_templates", F.size("images"))
