"""The formats, each from a list of rows (dicts) that a cap has bounded: human, markdown, pull request comment, SARIF, badge, annotations."""

from __future__ import annotations

import json
from collections.abc import Iterable
from itertools import takewhile

from . import cells


def location(row: dict) -> str:
    return f"{row['file']}:{row['line']}"


def summary_line(s: dict, threshold: float) -> str:
    if not s["total"]:
        return "No functions."
    worst = f" Worst: {s['worst_name']} ({cells.score(s['worst_crap'])}) in {s['worst_file']}." if s.get("worst_name") else ""
    return f"{s['crappy']} of {s['total']} functions over {threshold:g}.{worst}"


def table(head: list[str], rows: list[list[str]], right: set[int] = frozenset()) -> list[str]:
    widths = [max(len(r[i]) for r in [head, *rows]) for i in range(len(head))]
    pad = lambda r: "  ".join(c.rjust(w) if i in right else c.ljust(w) for i, (c, w) in enumerate(zip(r, widths, strict=True))).rstrip()
    return [pad(head), pad(["-" * w for w in widths]), *map(pad, rows)]


def shortened(text: str, width: int, keep_end: bool = False) -> str:
    if len(text) <= width:
        return text
    return "…" + text[len(text) - width + 1 :] if keep_end else text[: width - 1] + "…"


def human(rows: list[dict], width: int = 100, left_out: int = 0) -> str:
    """A table that fits a width: a bar of ten or five cells where there is room, no complexity column under 60; then the uncovered lines are cut first, the location next, the name last."""
    cells_of_bar = 10 if width >= 100 else 5 if width >= 80 else 0
    head = ["CRAP", *(["CC"] if width >= 60 else []), "Coverage", "Function", "Location", "Uncovered"]
    name, place, last = head.index("Function"), head.index("Location"), head.index("Uncovered")
    out = []
    for r in rows:
        cover = cells.percent(r.get("coverage")) + (f" {cells.bar(r.get('coverage'), cells_of_bar)}" if cells_of_bar else "")
        out.append([cells.score(r["crap"]), *([cells.count(r["cc"])] if width >= 60 else []), cover, r["name"], location(r), cells.ranges(r.get("uncovered"))])
    size = lambda i: max(len(x[i]) for x in [head, *out])
    for column, floor in ((last, 9), (place, 12), (name, 10)):
        over = sum(size(i) for i in range(len(head))) + 2 * (len(head) - 1) - width
        if over > 0:
            room = max(floor, size(column) - over)
            out = [[shortened(c, room, column == place) if i == column else c for i, c in enumerate(r)] for r in out]
    lines = table(head, out, {0, 1} if width >= 60 else {0})
    return "\n".join([*lines, *([f"… and {left_out} more"] if left_out else [])]) + "\n"


def cell(text: object) -> str:
    return str(text).replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")


def markdown_table(head: list[str], rows: Iterable[list]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]


def markdown(rows: list[dict], summary: dict, threshold: float, link=lambda row: None) -> str:
    """Every row, in the order given."""
    where = lambda r: f"[{location(r)}]({u})" if (u := link(r)) else f"`{location(r)}`"
    body = markdown_table(["CRAP", "CC", "Coverage", "Function", "Location", "Uncovered"], ([cells.score(r["crap"]), cells.count(r["cc"]), cells.percent(r.get("coverage")), f"`{r['name']}`", where(r), cells.ranges(r.get("uncovered"))] for r in rows))
    return "\n".join(["# Change risk", "", summary_line(summary, threshold), "", *body]) + "\n"


#: The sections of a comment, in their order.
SECTIONS = ("regressed", "new over the threshold", "over the threshold", "improved", "moved", "new")


def section(row: dict, threshold: float) -> str | None:
    status, over = row.get("status"), row["crap"] > threshold
    if status == "new":
        return SECTIONS[1] if over else SECTIONS[5]
    return {"regressed": SECTIONS[0], "improved": SECTIONS[3], "moved": SECTIONS[4]}.get(status, SECTIONS[2] if over else None)


def common_folder(paths: list[str]) -> str:
    split = [p.split("/")[:-1] for p in paths]
    same = [c[0] for c in takewhile(lambda c: len(set(c)) == 1, zip(*split, strict=False))]
    return "/".join(same) + "/" if same else ""


def comment(rows: list[dict], threshold: float, most: int = 25) -> str:
    """Sections with their own orders (by change where there is one, else by score), `most` rows each; the folder that all paths share stands above. All but the first two are folded."""
    folder = common_folder([r["file"] for r in rows]) if len(rows) > 1 else ""
    out = ["## Change risk", ""] + ([f"Paths are below `{folder}`.", ""] if folder else [])
    for name in SECTIONS:
        own = [r for r in rows if section(r, threshold) == name]
        if not own:
            continue
        by_change = name in ("regressed", "improved")
        own.sort(key=lambda r: (-abs(r["crap"] - r["baseline_crap"]) if by_change else -r["crap"], r["file"], r["name"], r["line"]))
        change = lambda r: cells.change(None if r.get("baseline_crap") is None else r["crap"] - r["baseline_crap"])
        body = markdown_table(["CRAP", "Change", "Function", "Location"], ([cells.score(r["crap"]), change(r), f"`{r['name']}`", f"`{r['file'][len(folder):]}:{r['line']}`"] for r in own[:most]))
        body += ["", f"… and {len(own) - most} more"] if len(own) > most else []
        title = f"{name} ({len(own)})"
        out += [f"### {title}", "", *body, ""] if name in SECTIONS[:2] else ["<details>", f"<summary>{title}</summary>", "", *body, "", "</details>", ""]
    return "\n".join(out)


def sarif(rows: list[dict], threshold: float, compared: bool = False) -> str:
    """SARIF 2.1.0 of the rows over the threshold. A comparison has no place in it."""
    if compared:
        raise ValueError("SARIF has no comparison with a baseline")
    found = [
        {
            "ruleId": "change-risk", "level": "warning",
            "message": {"text": f"{r['name']} has a change risk of {cells.score(r['crap'])} (complexity {cells.count(r['cc'])}, coverage {cells.percent(r.get('coverage'))})"},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["file"]}, "region": {"startLine": r["line"]}}}],
        }
        for r in rows if r["crap"] > threshold
    ]
    rule = {"id": "change-risk", "shortDescription": {"text": "Complex code with little coverage"}}
    run = {"tool": {"driver": {"name": "riskframe", "rules": [rule]}}, "results": found}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}, indent=2) + "\n"


def badge(crappy: int) -> str:
    colour, text = ("brightgreen", "passing") if not crappy else ("yellow" if crappy <= 5 else "red", f"{crappy} over")
    return json.dumps({"schemaVersion": 1, "label": "change risk", "message": text, "color": colour}) + "\n"


def reasons(rows: list[dict]) -> str:
    """The gating ones first, then in the order of the report."""
    order = sorted(rows, key=lambda r: (not r["gating"], r["ord"], r["rank"]))
    return "".join(f"{'!' if r['gating'] else ' '} {r['name']} ({r['file']}): {cells.reason(r)}\n" for r in order)


def duplicates(groups: list[dict], compared: bool = False, named: int = 5) -> str:
    """Groups with at most `named` members each; in a comparison only those that are new or grew. Verdicts have a column only where every group has one."""
    shown = [g for g in groups if not compared or g.get("status") in ("new", "grown")]
    judged = bool(shown) and all(g.get("verdict") for g in shown)
    rows = []
    for g in shown:
        more = len(g["members"]) - named
        rows.append([f"{g['score']:.2f}", ", ".join(g["members"][:named]) + (f" +{more} more" if more > 0 else ""), *([g["verdict"]] if judged else [])])
    return "\n".join(markdown_table(["Similarity", "Functions", *(["Verdict"] if judged else [])], rows)) + "\n" if rows else ""
