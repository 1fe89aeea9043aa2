"""The tools: an index of a code base, and the questions it answers."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, paths, roles, topics
from ..functions.settings import Retrieval
from ..operators import architecture, changes, explore, findings, flow, graph, postings, retrieval
from ..sources import code, resolution
from ..sources.tables import load, save, written
from ..sources.versions import Versions

# What a question about a flow says.
FLOW = re.compile(r"(?i)(flow|流程|how does|怎么|如何|reach|调用链|login|登录|request|请求)")

#: Symbols that one name may stand for in a question; the first by name count.
MOST_REFS = 200


def flow_starts() -> list[str]:
    """Roles of the uppermost layer."""
    top = min(roles.LAYER.values())
    return [r for r, rank in roles.LAYER.items() if rank == top]


@dataclass
class CodeIndex:
    files: DataFrame
    parsed: DataFrame
    definitions: DataFrame
    chunks: DataFrame
    edges: DataFrame

    # --- building ----------------------------------------------------------------

    @classmethod
    def build(cls, spark: SparkSession, folder: str) -> CodeIndex:
        return cls.from_files(spark, code.read_tree(spark, folder))

    @classmethod
    def from_files(cls, spark: SparkSession, files: DataFrame) -> CodeIndex:
        """files: file_path, content."""
        files = files.withColumn("language", paths.language(F.col("file_path"))).where("language is not null").withColumn("content_hash", ids.content_hash(F.col("content")))
        parsed = written(code.parsed(files), "parsed")
        return cls._of(written(files, "files"), parsed)

    @classmethod
    def _of(cls, files: DataFrame, parsed: DataFrame, edges: DataFrame | None = None) -> CodeIndex:
        defs = code.definitions(parsed)
        return cls(files, parsed, defs, code.chunks(files, defs), written(edges if edges is not None else code.edges(parsed, defs, files), "edges"))

    def save(self, path: str, repo: str) -> None:
        for name in ("files", "parsed", "chunks", "edges"):
            save(getattr(self, name).withColumn("repo_id", F.lit(repo)), f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, repo: str) -> CodeIndex | None:
        got = [load(spark, f"{path}/{name}") for name in ("files", "parsed", "chunks", "edges")]
        if any(x is None for x in got):
            return None
        files, parsed, chunks, edges = (x.where(F.col("repo_id") == repo).drop("repo_id") for x in got)
        return cls(files, parsed, code.definitions(parsed), chunks, edges)

    def commit(self, folder: str) -> dict[str, dict[str, int]]:
        """Writes what differs from the folder's last version, all tables in one version, and the lexical index; counts by table.

        Nodes have their role as canonical JSON, edges their evidence, chunks
        their place in their file.
        """
        nodes = self.nodes()
        meta = F.to_json(F.struct(F.col("role").alias("role")))
        nodes = nodes.select("id", "kind", "name", "qualified_name", "file_path", "start_line", "end_line", "language", "parent_id", meta.alias("meta"))
        edges = graph.with_line_evidence(self.edges)
        place = F.row_number().over(retrieval.Window.partitionBy("file_path").orderBy("start_line", "end_line", "chunk_id")) - 1
        counts = Versions(self.spark, folder).sync({
            "files": (self.files, ["file_path"]), "parsed": (self.parsed, ["file_path"]), "nodes": (nodes, ["id"]),
            "edges": (edges, ["edge_type", "source", "target", "relation"]), "chunks": (self.chunks.withColumn("ordinal", place), ["chunk_id"]),
        })
        own = self._corpus()
        try:
            postings.Postings(self.spark, f"{folder}/postings").updated(own)
        except FileNotFoundError:
            postings.Postings.build(f"{folder}/postings", own)
        return counts

    @classmethod
    def open(cls, spark: SparkSession, folder: str, version: int | None = None) -> CodeIndex | None:
        """The index of a version; searches read its kept postings. None if there is none."""
        kept = Versions(spark, folder)
        now = kept.manifest(version)
        if "edges" not in now["tables"]:
            return None
        files, parsed, chunks, edges = (kept.read(n, manifest=now).drop("row_hash") for n in ("files", "parsed", "chunks", "edges"))
        made = cls(files, parsed, code.definitions(parsed), chunks.drop("ordinal"), edges.drop("evidence"))
        if version is None:
            made.__dict__["_kept_postings"] = postings.Postings(spark, f"{folder}/postings")
        return made

    def _structure(self, parsed: DataFrame) -> DataFrame:
        defs = code.definitions(parsed)
        calls = parsed.select("file_path", F.explode("calls").alias("c")).select("file_path", "c.*")
        imports = parsed.select("file_path", F.explode("imports").alias("i")).select("file_path", F.concat_ws("|", "i.module", "i.name", "i.alias").alias("target"))
        return changes.structure_hash(defs, calls, imports)

    def changes(self, new: DataFrame) -> dict[str, object]:
        """Of new files: the mode of the update, and changed files with whether their structure changed."""
        new = new.withColumn("language", paths.language(F.col("file_path"))).where("language is not null").withColumn("content_hash", ids.content_hash(F.col("content")))
        status = changes.compared(self.files, new)
        counts = dict(status.groupBy("status").count().collect())
        moved = status.where("status = 'changed'")
        fresh = code.parsed(new.join(moved.select("file_path"), "file_path", "left_semi"))
        return {"mode": changes.update_mode(counts), "counts": counts, "status": status, "changed": changes.structural(moved, self._structure(self.parsed), self._structure(fresh)), "files": new}

    def updated(self, new: DataFrame) -> CodeIndex:
        """The index of ``new``; only changed files are parsed, and only edges that may have changed are resolved."""
        plan = self.changes(new)
        if plan["mode"] == "cached":
            return self
        files, status = written(plan["files"], "files"), plan["status"]
        kept = self.parsed.join(status.where("status = 'unchanged'").select("file_path"), "file_path", "left_semi")
        fresh = code.parsed(files.join(status.where("status in ('added', 'changed')").select("file_path"), "file_path", "left_semi"))
        parsed = written(kept.unionByName(fresh), "parsed")
        if plan["mode"] == "full":
            return self._of(files, parsed)
        moved = status.where("status != 'unchanged'").select("file_path")
        defs = code.definitions(parsed)
        of = lambda d: d.join(moved, "file_path", "left_semi")
        asks = resolution.asked(parsed, code.import_candidates(parsed))
        redo = written(resolution.waiting(asks, moved, of(self.definitions).unionByName(of(defs)), defs, parsed), "waiting")
        partial = code.edges(parsed.join(redo, "file_path", "left_semi"), defs, files)
        # What nobody waits for is as it was.
        kept = self.edges.join(redo.withColumnRenamed("file_path", "__f"), ids.ref_file(F.col("source")) == F.col("__f"), "left_anti")
        return self._of(files, parsed, kept.unionByName(partial))

    # --- tools --------------------------------------------------------------------

    @property
    def spark(self) -> SparkSession:
        return self.files.sparkSession

    def _refs(self, name: str) -> list[str]:
        known = self.definitions.select("ref").unionByName(self.edges.where("edge_type != 'import'").select(F.explode(F.array("source", "target")).alias("ref"))).distinct()
        asked = self.spark.createDataFrame([(name,)], "name string")
        return [r.ref for r in graph.resolve_names(asked, known).orderBy("ref").limit(MOST_REFS).collect()]

    def _seeds(self, refs: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(r,) for r in refs], "seed string")

    def nodes(self) -> DataFrame:
        made = graph.knowledge_nodes(self.files, self.definitions, self.edges)
        return roles.with_roles(made, self.files)

    def query_dependencies(self, symbol: str, direction: str = "both", limit: int = 20) -> dict[str, list[str]]:
        seeds, out = self._seeds(self._refs(symbol)), {}
        for name, kind, way in (("callers", "call", "in"), ("callees", "call", "out"), ("subtypes", "inherit", "in"), ("supertypes", "inherit", "out")):
            if direction == "both" or (way == "in") == (direction in ("in", "callers")):
                rows = graph.related(self.edges, seeds, kind, way).select("ref").distinct().orderBy("ref").limit(min(limit, 50)).collect()
                out[name] = [r.ref for r in rows]
        return out

    def analyze_impact(self, symbol: str, depth: int = 2, direction: str = "both", limit: int = 50) -> dict[str, list[dict]]:
        seeds = self._seeds(self._refs(symbol))
        ways = ("affected", "depends_on") if direction == "both" else (direction,)
        return {w: [r.asDict() for r in graph.impact(self.edges, seeds, depth, w, limit).orderBy("hops", "ref").collect()] for w in ways}

    def kept(self, name: str, make) -> object:
        """What searches need again and again is made once for an index."""
        if name not in self.__dict__:
            self.__dict__[name] = make()
        return self.__dict__[name]

    def _corpus(self) -> DataFrame:
        text = F.concat_ws(" ", "file_path", "symbol_name", "content")
        return self.chunks.withColumn("doc_id", F.col("chunk_id")).withColumn("text", text)

    def _channels(self, query: str, settings: Retrieval) -> DataFrame:
        own, asked = self._corpus(), self.spark.createDataFrame([(1, query)], "query_id int, text string")
        kept = self.__dict__.get("_kept_postings")
        if kept is not None:
            lexical = kept.search(asked, settings.top_k_bm25)
        else:
            index = self.kept("_postings", lambda: retrieval.bm25_index(own))
            lexical = retrieval.top_k(retrieval.bm25_scores(index, asked), settings.top_k_bm25)
        vectors = self.kept("_vectors", lambda: written(retrieval.hash_embedding(own, digest="blake2b"), "vectors"))
        of = retrieval.hash_embedding(asked, doc_id="query_id", digest="blake2b").withColumnRenamed("doc_id", "query_id")
        vector = retrieval.top_k(retrieval.sparse_scores(vectors, of).withColumn("score", F.round("score", 9)).where("score > 0"), settings.top_k_vector)
        keep = lambda df, name: df.select("query_id", "doc_id", F.lit(name).alias("channel"), "score", "rank")
        return keep(lexical, "bm25").unionByName(keep(vector, "vector"))

    def search(self, query: str, top_k: int = 10, mode: str = "hybrid", settings: Retrieval | None = None, rerank=None, language: str | None = None) -> DataFrame:
        """Chunks by lexical and vector search, fused, boosted by source quality and, if a reranker is given, reranked.

        ``mode`` is hybrid, vector or bm25; ``rerank`` gives a score column of
        (query, content); ``language`` keeps chunks of one language.
        """
        s = settings or Retrieval(top_k_vector=50, top_k_bm25=50, rerank_top_n=max(top_k, 8), final_top_n=top_k)
        own = self._corpus().withColumn("query", F.lit(query))
        if language is not None:
            own = own.where(F.col("language") == language)
        return retrieval.retrieved(self._channels(query, s), own, s, mode, rerank)

    def expanded(self, hits: DataFrame, limit: int = 4) -> DataFrame:
        """Chunks of callers and callees of the hits' symbols, with the reason; score 0."""
        chunks = self.chunks.where("symbol_name is not null").withColumn("ref", F.concat("file_path", F.lit("::"), "symbol_name"))
        seen = hits.where("symbol_name is not null").select("query_id", "chunk_id", F.concat("file_path", F.lit("::"), "symbol_name").alias("ref"), "rank")
        calls = self.edges.where("edge_type = 'call'").select(F.col("source").alias("caller"), F.col("target").alias("callee")).distinct()
        return retrieval.one_hop(seen, calls, chunks.select("chunk_id", "ref"), limit).join(self.chunks, "chunk_id").withColumn("score", F.lit(0.0))

    def sample(self, k: int) -> DataFrame:
        """What to show where a search finds nothing: chunks of different files, source files first."""
        return retrieval.diverse(self.chunks.withColumn("ordinal", F.struct("file_path", "start_line")), k).withColumn("score", F.lit(0.0)).withColumn("rank", F.row_number().over(retrieval.Window.orderBy("pass", "ordinal")))

    def search_code(self, query: str, top_k: int = 10, graph_expand: bool = False, mode: str = "hybrid", settings: Retrieval | None = None, rerank=None, language: str | None = None) -> list[dict]:
        """The best chunks, and with ``graph_expand`` chunks next to them in the call graph (``reason`` says how)."""
        keep = ("file_path", "start_line", "end_line", "symbol_name", "kind", "score")
        hits = self.search(query, min(top_k, 50), mode, settings, rerank, language)
        out = [r.asDict() | {"reason": None} for r in hits.orderBy("rank").select(*keep).collect()]
        if graph_expand:
            out += [r.asDict() for r in self.expanded(hits).orderBy("position").select(*keep, "reason").collect()]
        return out

    def view_source(self, file_path: str, symbol: str | None = None, start: int | None = None, end: int | None = None, most_lines: int = 400, most_chars: int = 20_000) -> dict:
        """Lines of a file or symbol, up to both limits; ``next_line`` is where to go on if they cut it, ``outline`` lists the file's definitions."""
        f = self.files.where(F.col("file_path") == file_path)
        if symbol:
            d = self.definitions.where((F.col("file_path") == file_path) & ((F.col("name") == symbol) | (F.concat_ws(".", "parent_name", "name") == symbol))).orderBy("ordinal").limit(1)
            f = f.join(d.select("file_path", "start_line", "end_line"), "file_path")
        else:
            f = f.withColumn("start_line", F.lit(start or 1)).withColumn("end_line", F.coalesce(F.lit(end), F.size(F.split("content", "\n", -1))))
        last = F.least("end_line", F.col("start_line") + most_lines - 1)
        text = F.array_join(F.slice(F.split("content", "\n", -1), F.col("start_line"), last - F.col("start_line") + 1), "\n")
        r = f.select("file_path", "start_line", last.alias("end_line"), text.alias("content"), (last < F.col("end_line")).alias("cut")).first()
        if not r:
            return {}
        out = r.asDict()
        if len(out["content"]) > most_chars:
            whole = out["content"][: most_chars + 1].rsplit("\n", 1)[0] if "\n" in out["content"][: most_chars + 1] else out["content"][:most_chars]
            out |= {"content": whole[:most_chars], "end_line": out["start_line"] + whole.count("\n"), "cut": True}
        outline = self.definitions.where(F.col("file_path") == file_path).orderBy("start_line").limit(200).select("kind", F.concat_ws(".", "parent_name", "name").alias("symbol"), "start_line", "end_line").collect()
        return out | {"next_line": out["end_line"] + 1 if out["cut"] else None, "outline": [x.asDict() for x in outline]}

    def entries(self, question: str, k: int = 5, hint: str | None = None, nodes: DataFrame | None = None) -> DataFrame:
        """Where a question's flow may start, best first; see :func:`flow.entries`."""
        _, terms = topics.topic(question)
        # The question, what its topic is called that it doesn't say itself, and the roles that flows start in.
        said = question.lower()
        words = [question.strip(), *(t for t in terms if t not in said), *flow_starts()]
        hits = self.search(" ".join(words), 8).select("rank", "file_path", "symbol_name")
        nodes = nodes if nodes is not None else self.nodes()
        return flow.entries(nodes, self.edges, terms, topics.entry_hint(hint), flow.retrieval_boosts(nodes, hits), None, k)

    def trace_flow(self, question: str, depth: int = 5, hint: str | None = None, most: int = 3) -> dict:
        """The best call path from an entry, step by step with citations, and other paths."""
        _, terms = topics.topic(question)
        nodes = written(self.nodes(), "nodes")
        first = self.entries(question, 5, hint, nodes).orderBy("position").collect()
        if not first:
            return {"steps": [], "score": 0.0, "alternatives": [], "cited": [], "confidence": "low", "unresolved": ["no_entry_candidate"], "warnings": []}
        warnings = [] if first[0].role in ("controller", "gateway") else [f"entry_role_is_{first[0].role}_not_controller"]
        starts = self.spark.createDataFrame([(r.qualified_name,) for r in first[:3]], "entry string")
        found = graph.beam_search(nodes.withColumn("id", F.col("qualified_name")), self.edges, starts, terms, min(depth, 10), max(4, most + 1), most=most).collect()
        rank = {r.qualified_name: r.position for r in first}
        best = sorted(found, key=lambda r: (-r.score, rank[r.entry], r.path))
        unresolved = [f"no_call_path_from:{r.id}" for r in first[:3] if r.qualified_name not in {b.entry for b in best}]
        path = best[0].path if best else [first[0].qualified_name]
        own = self.spark.createDataFrame([(1, path)], "path_id int, refs array<string>").select("path_id", F.transform("refs", lambda r: ids.symbol_node(r)).alias("path"))
        cited = [r.asDict() for r in flow.steps(own, nodes).orderBy("step").collect()]
        unresolved += [r["problem"] for r in cited if r["problem"]]
        if best:
            confidence = self._path_confidence(path, best[0].roles)
            confidence = "low" if any(r["confidence"] == "low" for r in cited) else "medium" if confidence == "high" and cited[-1]["id"] is None else confidence
        else:
            unresolved, confidence = [*unresolved, "partial_trace_entry_only"], "low"
        others = [list(p) for p in dict.fromkeys(tuple(r.path) for r in best[1:]) if list(p) != path]
        return {"steps": path, "score": best[0].score if best else first[0].score, "alternatives": others[: most - 1], "cited": cited, "confidence": confidence, "unresolved": list(dict.fromkeys(unresolved)), "warnings": warnings}

    def _path_confidence(self, path: list[str], role_path: list[str]) -> str:
        pairs = self.spark.createDataFrame(list(zip(path[:-1], path[1:], strict=True)), "source string, target string")
        lines = self.edges.where("edge_type = 'call'").groupBy("source", "target").agg(F.min("line").alias("line"))
        own = flow.call_evidence(self.edges).join(lines, ["source", "target"]).join(F.broadcast(pairs), ["source", "target"])
        edges = own.agg(F.collect_list(ids.confidence_bucket(F.col("confidence"))).alias("buckets"), F.count_if(F.col("line").isNull()).alias("missing"))
        return edges.select(graph.path_confidence(F.col("buckets"), F.col("missing"), F.array(*map(F.lit, role_path))).alias("c")).first().c

    def context_explore(self, query: str, top_k: int = 8, depth: int = 2, limit: int = 40, flow_too: bool | None = None) -> dict:
        """Seeds with their citation and beginning, call paths with roles, and the blast radius with the lines of its calls.

        Paths come from the flow tracer if the question is about a flow (or
        ``flow_too`` says so), and from the first callees of the first three seeds.
        """
        hits = self.search(query, min(top_k, 20))
        if hits.isEmpty():
            hits = self.sample(top_k).withColumn("query_id", F.lit(1))
        found = explore.seeds(hits, min(top_k, 20)).orderBy("place").drop("query_id").collect()
        refs = [r.ref for r in found if "::" in r.ref]
        out = {"seeds": [r.ref for r in found], "must_read": [r.asDict() for r in found], "blast_radius": [], "chains": [], "call_paths": []}
        if not refs:
            return out
        blast = written(graph.blast_radius(self.edges, self._seeds(refs), min(depth, 4)), "blast")
        blast = explore.with_call_lines(blast, self.edges).groupBy("ref", "relation").agg(F.min(F.struct("hops", F.col("citation").isNull().alias("bare"), "seed", "citation", "strategy")).alias("b"))
        out["blast_radius"] = [r.asDict() for r in blast.select("ref", "relation", "b.hops", "b.citation", "b.strategy").orderBy("hops", "relation", "ref").limit(limit).collect()]
        if flow_too if flow_too is not None else FLOW.search(query):
            trace = self.trace_flow(query)
            if trace["cited"]:
                out["call_paths"].append({"source": "flow_tracer", "score": trace["score"], "confidence": trace["confidence"], "steps": trace["cited"]})
            out["chains"].append(trace["steps"])
        chains = graph.call_chain(self.edges, self._seeds(refs[:3])).withColumn("path_id", F.col("seed"))
        own = flow.steps(chains.select("path_id", F.transform("path", lambda r: ids.symbol_node(r)).alias("path")), self.nodes()).where("id is not null")
        steps: dict[str, list[dict]] = {}
        for r in own.orderBy("path_id", "step").collect():
            steps.setdefault(r.path_id, []).append(r.asDict())
        for ref in (r for r in refs[:3] if r in steps):
            out["call_paths"].append({"source": "graph", "score": 0.5, "confidence": "medium", "steps": steps[ref]})
            out["chains"].append([x["id"].removeprefix(ids.SYMBOL) for x in steps[ref]])
        return out

    def _modules(self) -> tuple[DataFrame, DataFrame]:
        f = self.files.select("file_path").withColumn("module", F.coalesce(paths.cluster_key(F.col("file_path")), F.lit(".")))
        e = self.edges.where("edge_type in ('import', 'call')").select(ids.ref_file(F.col("source")).alias("source"), ids.ref_file(F.col("target")).alias("target"))
        return architecture.module_edges(e, f), f.select("module").distinct()

    def analyze_architecture(self) -> dict:
        pairs, names = self._modules()
        nodes = self.nodes()
        per = architecture.coupling(pairs, names).join(architecture.cohesion(pairs, names), "module")
        cycles = graph.cycles(pairs.select("source", "target"))
        patterns = architecture.ranked_patterns(architecture.pattern_scores(architecture.pattern_signals(nodes), architecture.layer_edges(self.edges, nodes, roles.layer), architecture.modules(nodes).where("module_type = 'layer'").agg(F.count("*").alias("n"))))
        modules, languages = architecture.modules(nodes), architecture.language_counts(self.files)
        nothing = self.spark.createDataFrame([], "name string, kind string, file_path string")
        proven = findings.boundary_findings(modules, nodes).unionByName(findings.pattern_findings(patterns, nodes, self.edges)).unionByName(findings.profile_findings(nothing, nothing, languages, nodes))
        return {
            "evidence": [r.asDict(True) for r in proven.orderBy("category", "finding_id").limit(1000).collect()],
            "totals": architecture.totals(pairs, names).first().asDict(),
            "modules": [r.asDict() for r in modules.join(per, "module", "left").orderBy("module").limit(1000).collect()],
            "findings": [r.asDict() for r in architecture.coupling_findings(per).orderBy("module", "finding").limit(1000).collect()],
            "cycles": [r.asDict() for r in architecture.cycle_findings(cycles).collect()],
            "patterns": [r.asDict() for r in patterns.orderBy("rank").collect()],
        }

    def get_initial_context(self, top_modules: int = 8, top_files: int = 5) -> dict:
        """Modules by falling coupling (the rest by name), entry points, and the beginnings of core files."""
        pairs, names = self._modules()
        ranked = written(architecture.coupling(pairs, names), "coupling")
        top = ranked.orderBy(F.desc("coupling"), "module").limit(top_modules).collect()
        rest = ranked.where(~F.col("module").isin([r.module for r in top])).orderBy("module").limit(1000).collect()
        entries = written(explore.entry_points(self.nodes()), "entry-points")
        files = self.files.select("file_path", "content", F.coalesce(paths.cluster_key(F.col("file_path")), F.lit(".")).alias("module"))
        core = explore.core_files(entries, ranked, files, top_files).orderBy("place").collect()
        warnings = [] if core else ["no core file has any text"]
        return {
            "modules": [r.asDict() for r in top],
            "remaining_modules": [r.asDict() for r in rest],
            "entrypoints": [r.entry for r in entries.orderBy("place").collect()],
            "core_files": [r.file_path for r in core],
            "excerpts": [r.asDict() for r in core],
            "warnings": warnings,
        }

    def get_repo_summary(self) -> dict:
        n = self.files.count()
        languages = {r.language: r.n for r in architecture.language_counts(self.files).collect()}
        stats = {(r.what, r.kind): r.n for r in graph.statistics(self.nodes(), self.edges).collect()}
        return {"n_files": n, "languages": languages, "statistics": stats}

    def suggest_refactor(self, file_path: str, most: int = 5) -> list[dict]:
        """Long, much-called and much-calling definitions of a file."""
        d = self.definitions.where(F.col("file_path") == file_path).withColumn("lines", F.col("end_line") - F.col("start_line") + 1)
        out = self.edges.where("edge_type = 'call'").groupBy(F.col("source").alias("ref")).agg(F.count("*").alias("fan_out"))
        x = d.join(graph.fan_in(self.edges), "ref", "left").join(out, "ref", "left").fillna(0, ["fan_in", "fan_out"])
        why = F.array_compact(F.array(F.when(F.col("lines") > 60, F.lit("long")), F.when(F.col("fan_in") >= 10, F.lit("used by many")), F.when(F.col("fan_out") >= 10, F.lit("calls many"))))
        return [r.asDict() for r in x.withColumn("why", why).where(F.size("why") > 0).orderBy(F.desc("lines"), "ref").limit(most).select("ref", "lines", "fan_in", "fan_out", "why").collect()]
