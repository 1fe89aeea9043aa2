"""The analysis workflow: route, plan, retrieve, analyze, review with retries, report.

Each node is plain control flow around DataFrame operators; a node that runs
too long is interrupted by its tag.  Model calls over a network are left out;
the analyzer is a function that may be replaced.
"""

from __future__ import annotations

import json
import re
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import topics
from ..operators import context
from .tools import CodeIndex

PLANS = {
    "summary": ("What is the repository for and how is it laid out", "Which modules are central and how do they depend on each other", "Where does it start and how does data flow"),
    "refactor": ("Which definitions are long or used by many", "Where are modules coupled or in a circle", "Which changes would be safe first"),
    "interview": ("What does the code show of design decisions", "Which parts are worth a deeper question", "How is it tested and extended"),
}
RETRIES, TIMEOUT, MAX_QUERY = 2, 120.0, 220


@dataclass
class Finding:
    finding_id: int
    claim: str
    citations: list[str]
    symbols: list[str]
    step: int
    confidence: str = "high"


@dataclass
class State:
    question: str
    intent: str = "summary"
    plan: list[str] = field(default_factory=list)
    hits: list[dict] = field(default_factory=list)
    findings: list[Finding] = field(default_factory=list)
    issues: list[dict] = field(default_factory=list)
    retries: int = 0
    status: str = "ok"
    timings: dict[str, float] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)


Analyzer = Callable[[State], list[Finding]]


def by_turns(state: State) -> list[Finding]:
    """Deterministic: step i of the plan cites evidence i mod n."""
    if not state.hits:
        return []
    out = []
    for i, step in enumerate(state.plan):
        h = state.hits[i % len(state.hits)]
        out.append(Finding(i + 1, f"{step}: see {h['symbol_name'] or h['file_path']}", [cite(h)], [h["symbol_name"].split(".")[-1]] if h["symbol_name"] else [], i))
    return out


def cite(hit: dict) -> str:
    return f"{hit['file_path']}:{hit['start_line']}-{hit['end_line']}"


def queries(state: State) -> list[str]:
    """What to search for, wider with each retry."""
    words = [w for w in re.findall(r"[A-Za-z_]\w+", state.question) if w.lower() not in topics.STOP]
    _, terms = topics.topic(state.question)
    tries = [" ".join(dict.fromkeys([*words, *terms[:4]])), " ".join(terms), " ".join(words + [w for s in state.plan for w in s.split()])]
    return list(dict.fromkeys(t[:MAX_QUERY] for t in tries[state.retries :] + tries[: state.retries] if t))


def timed(index: CodeIndex, state: State, name: str, f: Callable[[], object], timeout: float = TIMEOUT) -> object:
    """Runs a node; after ``timeout`` its Spark jobs are interrupted and an error is noted."""
    spark, tag, began = index.spark, f"node-{name}-{time.monotonic_ns()}", time.monotonic()
    spark.addTag(tag)
    timer = threading.Timer(timeout, spark.interruptTag, [tag])
    timer.start()
    try:
        return f()
    except Exception as e:
        state.errors.append(f"{name}: {type(e).__name__}")
        state.status = "failed"
        return None
    finally:
        timer.cancel()
        spark.removeTag(tag)
        state.timings[name] = time.monotonic() - began


def review(index: CodeIndex, state: State) -> DataFrame:
    spark = index.spark
    rows = [(f.finding_id, f.claim, f.citations, f.symbols, f.step) for f in state.findings]
    findings = spark.createDataFrame(rows, "finding_id int, claim string, citations array<string>, symbols array<string>, step int")
    allowed = spark.createDataFrame([(cite(h), h["content"], False) for h in state.hits], "citation string, content string, expanded boolean").dropDuplicates(["citation"])
    plan = spark.createDataFrame(list(enumerate(state.plan)), "step int, question string")
    return context.review(findings, allowed, plan)


def steps(index: CodeIndex, state: State, hint: str | None = None, analyzer: Analyzer = by_turns, top_k: int = 8) -> Iterator[tuple[str, State]]:
    """Runs the workflow; yields after each node."""
    state.intent = topics.intent(state.question, hint)
    yield "route", state
    state.plan = list(PLANS[state.intent])
    yield "planner", state
    while True:
        for find in [*(lambda q=q: index.search(q, top_k) for q in queries(state)), lambda: index.sample(top_k)]:
            keep = ("file_path", "start_line", "end_line", "symbol_name", "content", "score")
            state.hits = timed(index, state, "retrieve", lambda find=find: [r.asDict() for r in find().orderBy("rank").select(*keep).collect()]) or []
            if state.hits:
                break
        yield "retrieve", state
        state.findings = analyzer(state)
        yield "analyze", state
        state.issues = timed(index, state, "review", lambda: [r.asDict() for r in review(index, state).orderBy("type", F.col("finding_id")).collect()]) or []
        yield "review", state
        if not any(i["severity"] == "high" for i in state.issues) or state.retries >= RETRIES:
            break
        state.retries += 1
    if state.status != "failed":
        state.status = "failed" if not state.findings else "partial" if any(i["severity"] == "high" for i in state.issues) else "ok"
    weak = {i["finding_id"] for i in state.issues}
    for f in state.findings:
        f.confidence = "low" if f.finding_id in weak else f.confidence
    yield "finalize", state


def run(index: CodeIndex, question: str, **options) -> State:
    state = State(question)
    for _ in steps(index, state, **options):
        pass
    return state


def events(index: CodeIndex, question: str, **options) -> Iterator[str]:
    """The workflow as server-sent events."""
    state = State(question)
    for name, s in steps(index, state, **options):
        yield frame({"node": name, "hits": len(s.hits), "findings": len(s.findings), "issues": len(s.issues), "status": s.status})


def frame(data: dict) -> str:
    return f"data: {json.dumps(data, ensure_ascii=False)}\n\n"


# --- reports ---------------------------------------------------------------------


def as_json(state: State) -> dict:
    return {"question": state.question, "intent": state.intent, "status": state.status, "plan": state.plan, "findings": [f.__dict__ for f in state.findings], "issues": state.issues, "retries": state.retries}


def as_markdown(state: State) -> str:
    out = [f"# {state.question}", "", f"Intent: {state.intent}. Status: {state.status}.", "", "## Findings", ""]
    out += [f"- {f.claim} ({', '.join(f.citations) or 'no citation'}; {f.confidence})" for f in state.findings] or ["None."]
    if state.issues:
        out += ["", "## Issues", "", *[f"- {i['type']}" + (f": {i['citation']}" if i["citation"] else "") for i in state.issues]]
    return "\n".join(out)


def impact_markdown(symbol: str, report: dict[str, list[dict]]) -> str:
    out = [f"# Impact of {symbol}"]
    for way, rows in report.items():
        out += ["", f"## {way.replace('_', ' ').capitalize()}", "", *([f"- {r['ref']} ({r['relation']}, {r['hops']} hops)" for r in rows] or ["None within the depth."])]
    return "\n".join(out)


def explore_markdown(query: str, got: dict) -> str:
    out = [f"# {query}", "", "## Read first", "", *[f"- {s}" for s in got["seeds"]], "", "## Call paths", "", *[f"- {' -> '.join(c)}" for c in got["chains"] if c]]
    return "\n".join([*out, "", "## Blast radius", "", *[f"- {h['ref']} ({h['relation']}, {h['hops']})" for h in got["blast_radius"]]])


def flow_markdown(trace: dict) -> str:
    return "\n".join(["# Flow", "", *[f"{i}. {s}" for i, s in enumerate(trace["steps"], 1)], "", f"Score: {trace['score']:.2f}", *[f"Also: {' -> '.join(a)}" for a in trace["alternatives"]]])


def architecture_markdown(report: dict) -> str:
    t = report["totals"]
    out = ["# Architecture", "", f"{t['module_count']} modules, {t['cross_edges']} edges between them, density {t['density']:.3f}.", "", "## Modules", ""]
    out += [f"- {m['module']}: {m['module_type']}, {m['responsibility']}" for m in report["modules"]]
    out += ["", "## Patterns", "", *[f"- {p['pattern']}: {p['score']:.2f}{' (primary)' if p['primary'] else ''}" for p in report["patterns"]]]
    return "\n".join([*out, "", "## Findings", "", *[f"- {f['module']}: {f['finding']}" for f in report["findings"]], *[f"- circle: {c['cycle']}" for c in report["cycles"]]])
