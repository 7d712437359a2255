"""Odd inputs for the whole queries: empty tables, and tables of nulls, repeats, very long texts and columns with clashing names."""

import pyarrow as pa
import pyarrow.parquet as pq

TABLES = ("centers", "center_groups", "hospitals", "sponsors", "funders", "studies", "detalle", "study_centers", "documents", "eval_items", "container_sizes")
SF = "/root/testdata/sf0.001"
CLASHES = ("node", "site", "s", "t", "a", "b", "u", "v", "k", "g", "n", "x", "p_cp", "_in0", "component", "bloque", "clave", "estado", "grupo", "tokens", "doc", "orden", "_json", "_t", "valor")


def empty_tables(folder):
    for name in TABLES:
        pq.write_table(pq.read_table(f"{SF}/{name}.parquet").slice(0, 0), f"{folder}/{name}.parquet")
    return str(folder)


def odd_tables(folder):
    """The first rows of every table, twice; a row of nulls (but for ids); a row of very long texts; 25 more columns."""
    for name in TABLES:
        t = pq.read_table(f"{SF}/{name}.parquet")
        head = t.slice(0, 40)
        ids = {"center_id", "detalle_id", "doc_id", "item_id", "sponsor_id", "funder_id", "codcnh", "container_id", "max_tokens"}
        row = head.slice(0, 1)
        nulls = pa.table([c if f.name in ids else pa.nulls(1, f.type) for c, f in zip(row.columns, row.schema)], schema=row.schema)
        long = pa.table([pa.array(["Hospital " + "áb? " * 20_000], f.type) if pa.types.is_string(f.type) and f.name not in ids else c for c, f in zip(row.columns, row.schema)], schema=row.schema)
        if name in ("center_groups", "container_sizes"):
            out = pa.concat_tables([head, head])
        else:
            out = pa.concat_tables([head, head, nulls, long])
        for c in CLASHES:
            if c not in out.column_names:
                out = out.append_column(c, pa.array(["clash"] * out.num_rows))
        pq.write_table(out, f"{folder}/{name}.parquet")
    return str(folder)
