"""Reports for people: the trace of a question as JSON and HTML, and evaluation results as Markdown."""

from __future__ import annotations

import json
import re
from datetime import UTC, datetime
from html import escape
from pathlib import Path

from docsift.sources.store import atomic_json


def _show(value: object, blank: str = "-") -> str:
    return escape(blank if value is None or value == "" else str(value))


def _seconds(value: float | None) -> str:
    return "-" if value is None else f"{value:.2f}s"


def sent_hits(trace: dict) -> list[bool]:
    """Of each hit, whether its numbered text stands in what was sent to the model."""
    sent = "\n".join(str(m.get("content", "")) for m in trace.get("messages") or [] if m.get("role") == "user")
    return [f"[{h.get('rank', k)}] {str(h.get('text', '')).strip()}" in sent for k, h in enumerate(trace.get("hits") or [], 1)]


def trace_html(trace: dict) -> str:
    """Question, timing, hits with what was sent of them, messages, neighbours of hits, answer and error."""
    flags = sent_hits(trace)
    hits = "".join(
        f"<details><summary>#{_show(h.get('rank', k))} {'sent' if flag else 'dropped'} {_show(h.get('source'))} p.{_show(h.get('page'))} score {_show(h.get('score'))}</summary><pre>{_show(h.get('text'), '')}</pre></details>"
        for k, (h, flag) in enumerate(zip(trace.get("hits") or [], flags, strict=True), 1)
    )
    messages = "".join(f"<h3>{_show(m.get('role'))}</h3><pre>{_show(m.get('content'), '')}</pre>" for m in trace.get("messages") or [])
    near = "".join(f"<h3>near #{_show(rank)}</h3>" + "".join(f"<pre>{_show(c.get('text'), '')}</pre>" for c in found) for rank, found in (trace.get("neighbors") or {}).items())
    timing = "".join(f"<li>{_show(k)}: {_seconds(v)}</li>" for k, v in (trace.get("timing") or {}).items())
    error = f"<p class='error'>{_show(trace.get('error'))}</p>" if trace.get("error") else ""
    parts = {"Hits": hits, "Messages": messages, "Neighbours": near, "Answer": f"<pre>{_show(trace.get('answer'), '')}</pre>{error}"}
    body = "".join(f"<section><h2>{name}</h2>{text or '<p>none</p>'}</section>" for name, text in parts.items())
    return f"<!doctype html><html><head><meta charset='utf-8'><title>Trace</title></head><body><h1>{_show(trace.get('question'))}</h1><p>{sum(flags)} of {len(flags)} hits sent</p><ul>{timing}</ul>{body}</body></html>"


def write_trace(trace: dict, folder: str, now: datetime | None = None) -> tuple[Path, Path]:
    """Writes the JSON and HTML of a trace; their name has the time and the beginning of the question."""
    plain = re.sub(r"[^0-9A-Za-z一-鿿]+", "-", trace.get("question") or "").strip("-")[:24] or "query"
    name = f"{(now or datetime.now(UTC)).strftime('%Y%m%d-%H%M%S')}-{plain}"
    data, page = Path(folder) / f"{name}.json", Path(folder) / f"{name}.html"
    atomic_json(str(data), trace)
    page.write_text(trace_html(trace), encoding="utf-8")
    return data, page


def _percent(value: float | None) -> str:
    return "" if value is None else f"{value * 100:.1f}%"


def judge_table(rows: list[dict]) -> str:
    """The judge summary as a Markdown table, one row for the whole set and one for each type of question."""
    names = {"hit_at_k": _percent, "recall_at_k": _percent, "reciprocal_rank": _percent}
    names |= dict.fromkeys(("recall_seconds", "rerank_seconds", "retrieval_seconds", "generation_seconds", "total_seconds"), lambda v: "" if v is None else f"{v:.2f}s")
    names |= dict.fromkeys(("correctness", "completeness", "relevance"), lambda v: "" if v is None else f"{v:.2f}")
    lines = ["| type | questions | " + " | ".join(names) + " |", "|-" * (len(names) + 2) + "|"]
    for r in sorted(rows, key=lambda r: (r["question_type"] is not None, r["question_type"] or "")):
        lines.append(f"| {r['question_type'] or 'all'} | {r['questions']} | " + " | ".join(show(r[n]) for n, show in names.items()) + " |")
    return "\n".join(lines) + "\n"


def results_markdown(rows: list[dict]) -> str:
    """Each question with its answer, judgement, state, timing and hits."""
    out = ["# Evaluation results", ""]
    for r in rows:
        judge = r.get("judge")
        scores = "not judged" if not judge else ", ".join(f"{n} {judge[n]}/3" for n in ("correctness", "completeness", "relevance")) + f": {judge['reason']}"
        out += [f"## {r['question_id']} ({r.get('question_type') or 'none'}, {r.get('difficulty') or 'none'})", ""]
        for title, key in (("Question", "question"), ("Reference", "ground_truth"), ("Answer", "answer"), ("Criteria", "eval_criteria")):
            out += [f"**{title}:** {r.get(key) or ''}", ""]
        out += [f"**Judgement:** {scores}", "", f"{r.get('status')}, {_seconds(r.get('total_seconds'))}, missing: {json.dumps(r.get('missing_sources') or [], ensure_ascii=False)}", ""]
        for h in r.get("hits") or []:
            out += [f"### [{h.get('rank')}] {h.get('source')} p.{h.get('page')} score {h.get('score')}", "", h.get("text") or "", ""]
    return "\n".join(out)
