"""Rule packs of chemistry: JSON files of SMARTS rules that are read when they are needed, with what is wrong in them.

A pack is one object of schemaVersion 1 with an array named classes (type, smarts, logP, mr),
groups (key, smarts, label) or alerts (key, smarts, label, mechanism, citation, severity).
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from labspark.kernels import chem

#: Fields that each rule of an array must have.
FIELDS = {"classes": ("type", "smarts", "logP", "mr"), "groups": ("key", "smarts", "label"), "alerts": ("key", "smarts", "label", "mechanism", "citation", "severity")}
NUMBERS = ("logP", "mr")
SEVERITIES = ("info", "warn")


def read_rules(spark: SparkSession, path: str, kind: str) -> tuple[list[dict], list[str]]:
    """(rules, errors) of one pack: rules in the file's order, which is that of precedence; faulty ones are told and left out.

    The file is read through Spark's text source, so that any shared path serves, and held
    whole on the driver: a pack is some hundred rules, whatever the data.
    """
    try:
        pack = json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
    except ValueError as e:
        return [], [f"{path}: {e}"]
    if not isinstance(pack, dict) or pack.get("schemaVersion") != 1:
        return [], [f"{path}: schemaVersion must be 1"]
    if not isinstance(pack.get(kind), list):
        return [], [f"{path}: there is no array {kind}"]
    rules, errors = [], []
    for at, rule in enumerate(pack[kind], 1):
        if why := _fault(rule, kind):
            errors.append(f"{path}: rule {at} of {kind}: {why}")
        else:
            rules.append({f: float(rule[f]) if f in NUMBERS else rule[f] for f in FIELDS[kind]})
    return rules, errors


def _fault(rule: object, kind: str) -> str | None:
    if not isinstance(rule, dict):
        return "it is no object"
    for field in FIELDS[kind]:
        kinds = (int, float) if field in NUMBERS else (str,)
        if not isinstance(rule.get(field), kinds) or rule[field] == "":
            return f"{field} is missing or of another type"
    if kind == "alerts" and rule["severity"] not in SEVERITIES:
        return f"severity {rule['severity']!r} is neither info nor warn"
    try:
        chem.Pattern(rule["smarts"])
    except chem.ChemError as e:
        return f"bad pattern {rule['smarts']!r}: {e}"
    return None
