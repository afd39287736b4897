"""The grammar of mappings against a scanner that reads one character after the other."""

import random
import re

from weftline.operators import spec


def parts(text, at):
    """The text cut at a character outside of double quotes."""
    out, quoted = [""], False
    for i, c in enumerate(text):
        if c == '"':
            quoted = not quoted and '"' in text[i + 1 :]
        if c == at and not quoted:
            out.append("")
        else:
            out[-1] += c
    return out


def condition_at(text):
    """Where the first condition outside of quotes begins, its word, and where what it asks begins."""
    quoted = False
    for i, c in enumerate(text):
        if c == '"':
            quoted = not quoted and '"' in text[i + 1 :]
        if not quoted and c == " " and (m := re.match(r" (when|if) ", text[i:], re.I)):
            return i, m[1], i + m.end()
    return None


def squeezed(text):
    out, quoted = "", False
    text = text.strip()
    for i, c in enumerate(text):
        if c == '"':
            quoted = not quoted and '"' in text[i + 1 :]
        if quoted or not (c == " " and (out[-1:] in (" ", "=") and not out.endswith('"'))):
            if c == "=" and not quoted and out.endswith(" "):
                out = out[:-1]
            out += c
    return out


def one(domain, text):
    if m := re.match(r"([A-Za-z_]\w*)=(.+)$", text):
        return (domain, m[1].upper(), "assignment", m[2].strip(), None)
    found = condition_at(text)
    if not found or not text[: found[0]].strip() or not text[found[2] :].strip():
        return (domain, text.upper(), "simple", None, None)
    name, asked = text[: found[0]].strip().upper(), text[found[2] :].strip()
    if name == "QVAL" and "QNAM" in asked.upper():
        q = re.search(r'QNAM="?([^"]*"|\w+)', asked, re.I)
        return (domain, name, "supp", f"{found[1]} {asked}", q[1].rstrip('"').upper() if q else None)
    m = re.match(r"(\w+)\s*=", asked.upper())
    return (domain, name, "conditional" if m and m[1].endswith(("TEST", "TESTCD")) else "conditional_other", f"{found[1]} {asked}", None)


def plain(domains, variables):
    domains, variables = squeezed(domains or ""), squeezed(variables or "")
    bars = parts(variables, "|")
    places = [d.strip().upper() for d in parts(domains, "|")] if len(bars) > 1 else [domains.upper()]
    out = []
    for i, group in enumerate(bars):
        group, domain = group.strip(), places[min(i, len(places) - 1)]
        if not group or not domain:
            continue
        slashes = parts(group, "/")
        shared = None
        if len(slashes) > 1 and not re.match(r"[A-Za-z_]\w*=", group):
            found = condition_at(group)
            if found and found[0] > 0 and len(parts(group[found[0] :], "/")) == 1:
                shared = f"{found[1]} {group[found[2] :]}"
                slashes = parts(group[: found[0]], "/")
        for v in slashes:
            v = v.strip()
            if v:
                out.append(one(domain, f"{v} {shared}" if shared and not re.search(r"\b(when|if)\b", v, re.I) else v))
    return out


def test_expressions_by_hand(spark):
    cases = [
        ("DM|DS", "AAA/BBB|CCC/DDD", [("DM", "AAA", "simple"), ("DM", "BBB", "simple"), ("DS", "CCC", "simple"), ("DS", "DDD", "simple")]),
        ("CM|PR", 'CMTRT when PRDYN="1"|PRTRT when PRDTN = "2"', [("CM", "CMTRT", "conditional_other"), ("PR", "PRTRT", "conditional_other")]),
        ("ae", "AESDTH/QVAL when QNAM=SAECAT", [("AE", "AESDTH", "conditional_other"), ("AE", "QVAL", "supp")]),
        ("VS", "VSORRES/VSORRESU when VSTESTCD=WEIGHT", [("VS", "VSORRES", "conditional"), ("VS", "VSORRESU", "conditional")]),
        ("DS", "DSCAT=方案里程碑 / DSSCAT=随机化 when RANDYN=是", [("DS", "DSCAT", "assignment"), ("DS", "DSSCAT", "assignment")]),
        ("DM", "A|B|C", [("DM", "A", "simple"), ("DM", "B", "simple"), ("DM", "C", "simple")]),
        ("", "A", []), ("DM", None, []), ("DM", " when X=1", [("DM", "WHEN X=1", "simple")]),
    ]
    df = spark.createDataFrame([(d, v) for d, v, _ in cases], "d string, v string")
    found = [[(m.domain, m.variable, m.kind) for m in r.m] for r in df.select(spec.grammar(df.d, df.v).alias("m")).collect()]
    assert found == [c[2] for c in cases]


def test_the_scanner_agrees(spark):
    rng = random.Random(6)
    atoms = ["AETERM", "qval", "QVAL", "X_1", "|", "/", " | ", " / ", " when ", " if ", " WHEN ", "=", " = ", "QNAM", "VSTEST", "VSTESTCD", '"a b"', '"x|y / z = 1"', '" when "', '"', " ", "  ", "体重", "1"]
    rows = [(rng.choice(["AE", "ae|dm", " AE | DM |VS", "|", "SUPPAE"]), "".join(rng.choice(atoms) for _ in range(rng.randint(1, 9)))) for _ in range(1500)]
    df = spark.createDataFrame(rows, "d string, v string")
    wrong = [(d, v, [tuple(m) for m in r.m], plain(d, v)) for (d, v), r in zip(rows, df.select(spec.grammar(df.d, df.v).alias("m")).collect()) if [tuple(m) for m in r.m] != plain(d, v)]
    assert not wrong, (len(wrong), wrong[:3])
