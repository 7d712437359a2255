"""Arrow stages over the pure functions of ``censo.functions``."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from censo.functions import places

#: Kinds between which a centre may be renamed.
FAMILY = {
    "clinica": "H", "general hospital": "H", "hospital universitario": "H", "comarcal hospital": "H", "hospital": "H",
    "centro salud": "C", "centro especialidades": "C", "instituto investigacion": "C",
}

PARSED = [
    T.StructField("p_tipo", T.StringType()), T.StructField("p_familia", T.StringType()), T.StructField("p_nucleo", T.ArrayType(T.StringType())),
    T.StructField("p_cola", T.StringType()), T.StructField("p_calle", T.StringType()), T.StructField("p_numero", T.StringType()),
    T.StructField("p_nombrado", T.BooleanType()), T.StructField("p_ciudad", T.StringType()), T.StructField("p_cp", T.StringType()),
    T.StructField("p_extranjero", T.BooleanType()), T.StructField("p_provincia", T.StringType()), T.StructField("p_ccaa", T.StringType()),
]


def kind_name(kind: tuple[str, ...]) -> str:
    """The plain name of a set of kind words; a clinic's 'Cl.' beside another kind is a street's abbreviation."""
    words = set(kind)
    if "clinica" in words and len(words) > 1:
        words.discard("clinica")
    if "salud" in words:
        words.add("centro")
    if words & {"universitario", "general", "comarcal"}:
        words.add("hospital")
    return " ".join(sorted(words))


def parse_places(df: DataFrame, name: str, town: str, code: str, province: str | None = None, region: str | None = None) -> DataFrame:
    """All columns of ``df`` and the parsed columns p_*; nulls parse as missing. Narrow, Arrow batches."""
    given = [name, town, code, province, region]
    inputs = [F.col(c).cast("string").alias(f"_in{i}") if c else F.lit(None).cast("string").alias(f"_in{i}") for i, c in enumerate(given)]
    schema = T.StructType([*df.schema.fields, *PARSED])
    n = len(df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out = {f.name: [] for f in PARSED}
            for nm, tw, cp, pr, rg in zip(*(part.column(n + i).to_pylist() for i in range(5))):
                c = places.parse_centre(nm, tw)
                kind = kind_name(c.kind)
                out["p_tipo"].append(kind)
                out["p_familia"].append(FAMILY.get(kind, ""))
                out["p_nucleo"].append([*c.opening, *c.stems])
                out["p_cola"].append(" ".join(c.tail))
                out["p_calle"].append(" ".join(sorted(c.street)))
                out["p_numero"].append(c.number)
                out["p_nombrado"].append(c.named)
                out["p_ciudad"].append(places.town_key(tw))
                out["p_cp"].append(places.postcode(cp))
                out["p_extranjero"].append(places.is_foreign_code(cp))
                out["p_provincia"].append(places.region_key(pr))
                out["p_ccaa"].append(places.region_key(rg))
            arrays = [part.column(i) for i in range(n)]
            arrays += [pa.array(out[f.name], pa.list_(pa.string()) if f.name == "p_nucleo" else pa.bool_() if f.name in ("p_nombrado", "p_extranjero") else pa.string()) for f in PARSED]
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in schema.fields])

    return df.select(*df.columns, *inputs).mapInArrow(run, schema)
