"""Schemas of the document model, and rows of it in Python kernels."""

from __future__ import annotations

RUN = "struct<text:string,bold:boolean,italic:boolean,font_size:float,color:int,strikethrough:boolean>"
BLOCK = (
    "block_index int, kind string, level int, ordered boolean, order_index int, language string, latex string, text string, "
    f"runs array<{RUN}>, headers array<array<{RUN}>>, rows array<array<array<{RUN}>>>, image string"
)
BLOCKS = f"doc_id long, {BLOCK}"
FIELDS = [c.split()[0] for c in "block_index kind level ordered order_index language latex text runs headers rows image".split()]


def run(text: str, bold: bool = False, italic: bool = False, strikethrough: bool = False) -> dict:
    return {"text": text, "bold": bold, "italic": italic, "font_size": None, "color": None, "strikethrough": strikethrough}


def merged(runs: list[dict]) -> list[dict]:
    """Neighbouring runs of equal style as one; empty ones go."""
    out: list[dict] = []
    for r in runs:
        if not r["text"]:
            continue
        if out and all(out[-1][k] == r[k] for k in r if k != "text"):
            out[-1] = out[-1] | {"text": out[-1]["text"] + r["text"]}
        else:
            out.append(r)
    return out


def block(kind: str, runs: list[dict] | None = None, **fields) -> dict:
    row = dict.fromkeys(FIELDS) | {"kind": kind} | fields
    if runs is not None:
        row["runs"] = merged(runs)
        row["text"] = "".join(r["text"] for r in row["runs"])
    return row


def numbered(blocks: list[dict]) -> list[dict]:
    return [b | {"block_index": i} for i, b in enumerate(blocks)]
