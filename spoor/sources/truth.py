"""Ground truth files: required keys, and their contracts and payments as tables.

A file is a page of YAML (or JSON, which needs no parser), read on the driver. YAML needs a parser, which may not
be installed.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from spoor.sources.records import prune

# What each part must have. A name in brackets is a list of such parts.
REQUIRED = {
    "obra_real": ("nome", "contratada"),
    "canal": ("id", "tipo", "parte_A", "parte_B"),
    "canal.parte_A": ("nome", "papel"),
    "canal.parte_B": ("nome", "papel"),
    "[contratos]": ("id", "escopo", "valor_total"),
    "[pagamentos_confirmados]": ("valor", "data"),
    "[pagamentos_pendentes]": ("valor",),
}
CONTRACTS = "id string, escopo string, valor_total double, forma_pagamento string, data_acordo string, status string"
PAID = "valor double, data string, hora string, contrato_ref string, parcela string, tipo string, descricao_pix string, nota string"
PENDING = "valor double, contrato_ref string, parcela string, gatilho_pagamento string, data_prevista string, nota string"


def loads(text: str) -> dict[str, Any]:
    if text.lstrip().startswith("{"):
        return validated(json.loads(text))
    import yaml  # only YAML needs it

    return validated(yaml.safe_load(text))


def dumps(value: dict[str, Any]) -> str:
    """Without empty values, in the order given."""
    kept = prune(value)
    try:
        import yaml
    except ImportError:
        return json.dumps(kept, ensure_ascii=False, indent=2)
    return yaml.safe_dump(kept, allow_unicode=True, sort_keys=False)


def validated(value: Any) -> dict[str, Any]:
    """The value, or an error that names every part that lacks something."""
    if not isinstance(value, dict):
        raise ValueError("ground truth is no map")
    missing = [k for k in ("obra_real", "canal") if not isinstance(value.get(k), dict)]
    for path, keys in REQUIRED.items():
        if path[0] == "[":
            parts = [(f"{path[1:-1]}[{i}]", x) for i, x in enumerate(value.get(path[1:-1]) or [])]
        else:
            part: Any = value
            for k in path.split("."):
                part = part.get(k) if isinstance(part, dict) else None
            parts = [(path, part)] if isinstance(part, dict) else []
        missing += [f"{name}.{k}" for name, x in parts for k in keys if not isinstance(x, dict) or x.get(k) is None]
    if missing:
        raise ValueError(f"ground truth lacks {', '.join(missing)}")
    return value


def tables(spark: SparkSession, value: dict[str, Any]) -> dict[str, DataFrame]:
    """contracts, paid and pending as DataFrames."""
    out = {}
    for name, key, schema in (("contracts", "contratos", CONTRACTS), ("paid", "pagamentos_confirmados", PAID), ("pending", "pagamentos_pendentes", PENDING)):
        columns = [c.split()[0] for c in schema.split(", ")]
        amounts = {"valor", "valor_total"}
        rows = [tuple(float(x[c]) if c in amounts else None if x.get(c) is None else str(x[c]) for c in columns) for x in value.get(key) or []]
        out[name] = spark.createDataFrame(rows, schema)
    return out
