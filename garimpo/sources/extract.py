"""Texts and graphs out of files: documents of many forms to markdown, and nodes and edges of Markdown, SQL, JSON manifests and Python."""

from __future__ import annotations

import ast
import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.sources.files import html_text_of

#: Endings by kind.
TEXTS = ["md", "mdx", "txt", "rst", "log", "json", "yaml", "yml", "toml", "ini", "xml"]
CODE = ["py", "js", "ts", "tsx", "jsx", "go", "rs", "java", "c", "h", "cpp", "hpp", "cs", "rb", "php", "swift", "kt", "sql", "sh", "lua"]
#: Fixed value: rows of a table that are given.
TABLE_ROWS = 500


def _row(cells: list[str]) -> str:
    return "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ").strip() for c in cells) + " |"


def table_text(rows: list[list[str]], most: int = TABLE_ROWS) -> str:
    """Rows as a markdown table: the first is the head, blank ones are left out, ``most`` at most behind the head."""
    own = [r for r in rows if any(c.strip() for c in r)][: most + 1]
    if not own:
        return ""
    wide = max(map(len, own))
    lines = [_row([*r, *[""] * (wide - len(r))]) for r in own]
    return "\n".join([lines[0], "|" + " --- |" * wide, *lines[1:]])


def _decoded(raw: bytes) -> str:
    for enc in ("utf-8-sig", "cp1252"):
        try:
            return raw.decode(enc)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


def _parts(z: zipfile.ZipFile, pattern: str) -> list[str]:
    number = lambda n: [int(x) for x in re.findall(r"\d+", n)]
    return sorted((n for n in z.namelist() if re.fullmatch(pattern, n)), key=number)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def docx_text(raw: bytes) -> str:
    """Paragraphs in order, headings as such, tables as tables."""
    out = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    said = lambda e: "".join(t.text or "" if _local(t.tag) == "t" else "\n" if _local(t.tag) == "br" else "\t" if _local(t.tag) == "tab" else "" for t in e.iter())
    for e in next(iter(body), []):
        if _local(e.tag) == "p":
            style = next((v for s in e.iter() if _local(s.tag) == "pStyle" for k, v in s.attrib.items() if _local(k) == "val"), "")
            level = re.fullmatch(r"(?i)heading\s*([1-6])|t[ií]tulo\s*([1-6])", style)
            if (text := said(e).strip()):
                out.append("#" * int(level[1] or level[2]) + " " + text if level else text)
        elif _local(e.tag) == "tbl":
            rows = [[said(c).strip() for c in r if _local(c.tag) == "tc"] for r in e if _local(r.tag) == "tr"]
            out.append(table_text(rows))
    return "\n\n".join(x for x in out if x)


def pptx_text(raw: bytes) -> str:
    """Slides in order, each with its number and its paragraphs."""
    out = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for i, name in enumerate(_parts(z, r"ppt/slides/slide\d+\.xml"), 1):
            paras = ["".join(t.text or "" for t in p.iter() if _local(t.tag) == "t") for p in ElementTree.fromstring(z.read(name)).iter() if _local(p.tag) == "p"]
            out.append("\n".join([f"## {i}", *(p for p in paras if p.strip())]))
    return "\n\n".join(out)


def xlsx_text(raw: bytes) -> str:
    """Sheets in order as tables; texts from the shared list, formulas by their stored value."""
    out = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter() if _local(t.tag) == "t") for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        titles = [s.attrib.get("name", "") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(s.tag) == "sheet"] if "xl/workbook.xml" in names else []
        for i, name in enumerate(_parts(z, r"xl/worksheets/sheet\d+\.xml")):
            rows = []
            for r in ElementTree.fromstring(z.read(name)).iter():
                if _local(r.tag) != "row":
                    continue
                cells: list[str] = []
                for c in r:
                    letters = re.match(r"[A-Z]+", c.attrib.get("r", ""))
                    at = 0
                    for ch in letters[0] if letters else "":
                        at = at * 26 + ord(ch) - 64
                    text = "".join(t.text or "" for t in c.iter() if _local(t.tag) in ("v", "t"))
                    if c.attrib.get("t") == "s" and text.isdigit() and int(text) < len(shared):
                        text = shared[int(text)]
                    cells += [""] * max(0, at - 1 - len(cells)) + [text]
                rows.append(cells)
            out.append(f"## {titles[i] if i < len(titles) else i + 1}\n\n{table_text(rows)}")
    return "\n\n".join(out)


def pdf_pages(raw: bytes) -> list[str] | None:
    """Texts of the pages; null where no reader for them is installed."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return None
    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(raw)).pages]


def text_of(path: str, raw: bytes) -> tuple[str | None, int | None, str | None]:
    """``(text, pages, error)`` of a file by its ending; what cannot be read gives its error and no text."""
    ending = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    try:
        if ending in TEXTS:
            return _decoded(raw), None, None
        if ending in CODE:
            return f"```{ending}\n{_decoded(raw).rstrip()}\n```", None, None
        if ending == "csv":
            return table_text(list(csv.reader(io.StringIO(_decoded(raw))))), None, None
        if ending in ("html", "htm"):
            return html_text_of(_decoded(raw)), None, None
        if ending in ("docx", "pptx", "xlsx"):
            return {"docx": docx_text, "pptx": pptx_text, "xlsx": xlsx_text}[ending](raw), None, None
        if ending == "pdf":
            pages = pdf_pages(raw)
            return (None, None, "no reader for pdf") if pages is None else ("\n\n".join(pages), len(pages), None)
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, csv.Error, ValueError) as e:
        return None, None, f"{type(e).__name__}: {e}"
    return None, None, f"unknown form {ending}"


def extract(files: DataFrame) -> DataFrame:
    """``(path, texto, paginas, erro)`` of files ``(path, content)``, as ``binaryFile`` reads them; one file at a time is held.

    ``without_substance`` of the text and pages tells scans and empty files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                path, raw = b.column(0)[i].as_py(), b.column(1)[i].as_py() or b""
                text, pages, error = text_of(path, raw)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([text], pa.string()), pa.array([pages], pa.int32()), pa.array([error], pa.string())], ["path", "texto", "paginas", "erro"])

    return files.select("path", "content").mapInArrow(run, "path string, texto string, paginas int, erro string")


# inventories: ignore files with negation, by folder

def ignored(paths: list[str], rules: list[tuple[str, str]]) -> list[bool]:
    """Whether each path is left out by ``rules`` (folder, pattern) in order: the last one that holds decides, ``!`` takes back.

    A pattern holds below its folder; with a slash inside it is anchored there. A file below a folder that is left out stays out.
    """
    from garimpo.sources.files import glob_pattern

    made = []
    for folder, line in rules:
        p = line.rstrip()
        if not p or p.startswith("#"):
            continue
        back = p.startswith("!")
        p = p.lstrip("!").removeprefix("\\")
        only = p.endswith("/")
        p = p.rstrip("/")
        anchored = "/" in p
        core = glob_pattern("/" + p.lstrip("/"))
        core = core.removesuffix("(?:/|$)")
        base = re.escape(folder.strip("/") + "/") if folder.strip("/") else ""
        made.append((re.compile(base + ("" if anchored else "(?:.*/)?") + core.removeprefix("/") + "$"), back, only))

    def out(path: str) -> bool:
        parts = path.strip("/").split("/")
        for i in range(1, len(parts) + 1):
            own, hit = "/".join(parts[:i]), False
            for rx, back, only in made:
                if (not only or i < len(parts)) and rx.match(own):
                    hit = not back
            if hit:
                return True
        return False

    return [out(p) for p in paths]


def kept_files(inventory: DataFrame, rules: list[tuple[str, str]], path: str = "path") -> DataFrame:
    """Rows of an inventory that no ignore rule leaves out; paths are relative to the root the rules are for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(path)
            yield b.filter(pa.array([not x for x in ignored(b.column(at).to_pylist(), rules)], pa.bool_()))

    return inventory.mapInArrow(run, inventory.schema)


#: Bytes over which a file is only listed.
READ_LIMIT = 5 << 20
#: Parts of names that promise secrets.
SENSITIVE = r"(?i)(^\.env(\..*)?$|^id_(rsa|dsa|ecdsa|ed25519)|\.(pem|key|p12|pfx|keystore|jks)$|credentials|secrets?\.(json|ya?ml|toml)$|^\.netrc$|^\.npmrc$|^\.pypirc$)"


def is_sensitive(path):  # noqa: ANN001, ANN201
    return F.element_at(F.split(path, "/"), -1).rlike(SENSITIVE)


def detect(spark: SparkSession, root: str, rules: list[tuple[str, str]] | None = None, limit: int = READ_LIMIT) -> DataFrame:
    """``(path, relativo, bytes, modificado, tipo, palavras)`` of the files below a folder, without ignored and secret ones.

    Kind by ending, else by the first line of a script. Words are counted in texts and code of up to ``limit`` bytes; larger files are listed.
    """
    base = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace("path", r"^.*?" + re.escape(root.rstrip("/").split("/")[-1]) + "/", "")
    f = base.select("path", rel.alias("relativo"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modificado"), F.when(F.col("length") <= limit, F.col("content")).alias("c"))
    f = f.where(~is_sensitive(F.col("path")))
    if rules:
        f = kept_files(f, rules, "relativo")
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    first = F.split(F.decode(F.substring("c", 1, 200), "utf-8"), "\n")[0]
    kind = F.when(ending.isin("md", "mdx", "txt", "rst", "html", "htm", "docx", "pptx"), "document").when(ending.isin(CODE), "code").when(ending == "pdf", "paper").when(ending.isin("csv", "json", "yaml", "yml", "xlsx", "parquet", "toml"), "data").when(ending.isin("png", "jpg", "jpeg", "gif", "svg", "webp"), "image").when(first.rlike(r"^#!.*\b(python|bash|sh|node|ruby|perl)"), "code").otherwise("other")
    text = F.when(kind.isin("document", "code") & ~ending.isin("docx", "pptx"), F.decode(F.col("c"), "utf-8"))
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return f.select("path", "relativo", "bytes", "modificado", kind.alias("tipo"), F.when(text.isNotNull(), words).alias("palavras"))


# nodes and edges

GRAPH = "id string, label string, source_file string, source_location string, file_type string, target string, relation string, confidence string"


def _slug(*parts: str) -> str:
    return "_".join(re.sub(r"[^a-z0-9]+", "_", p.lower()).strip("_") for p in parts if p)


def _node(path: str, name: str, label: str, line: int, kind: str = "code") -> tuple:
    return (_slug(path, name), label, path, f"L{line}", kind, None, None, None)


def _edge(a: str, b: str, relation: str, path: str, line: int, confidence: str = "EXTRACTED") -> tuple:
    return (a, None, path, f"L{line}", None, b, relation, confidence)


def markdown_graph(path: str, text: str) -> list[tuple]:
    """The file, its headings with what contains them, and once each document it links to; fenced code says nothing."""
    out = [_node(path, "", path.rsplit("/", 1)[-1], 1, "document")]
    open_: list[tuple[int, str]] = [(0, _slug(path))]
    seen, linked, fence = set(), set(), False
    for n, line in enumerate(text.split("\n"), 1):
        if re.match(r"\s*(```|~~~)", line):
            fence = not fence
        if fence:
            continue
        if (m := re.match(r"(#{1,6})[ \t]+(\S.*)", line)):
            level, title = len(m[1]), m[2].strip().rstrip("#").strip()
            own = _slug(path, title)
            own = f"{own}_{n}" if own in seen else own
            seen.add(own)
            while open_[-1][0] >= level:
                open_.pop()
            out += [(own, title, path, f"L{n}", "document", None, None, None), _edge(open_[-1][1], own, "contains", path, n)]
            open_.append((level, own))
        for a, b in re.findall(r"\[\[([^\]|#\n]+)[^\]\n]*\]\]|\]\(([^)\s#]+\.mdx?)(?:#[^)]*)?\)", line):
            target = (a or b).strip()
            if target and "://" not in target and target not in linked:
                linked.add(target)
                out.append(_edge(_slug(path), _slug(target.removesuffix(".md").removesuffix(".mdx")), "references", path, n))
    return out


def sql_graph(path: str, text: str) -> list[tuple]:
    """Tables, views and functions that are made, and the tables that they, keys and queries read or refer to."""
    bare = re.sub(r"--[^\n]*|/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    name = r'((?:"[^"]+"|`[^`]+`|[\w$]+)(?:\.(?:"[^"]+"|`[^`]+`|[\w$]+))*)'
    clean = lambda x: re.sub(r'["`]', "", x).split(".")[-1].lower()
    out = [_node(path, "", path.rsplit("/", 1)[-1], 1)]
    made: set[str] = set()
    for s in re.finditer(r"[^;]+(?:;|\Z)", bare):
        line = bare.count("\n", 0, s.start() + len(s[0]) - len(s[0].lstrip())) + 1
        own = _slug(path)
        if (m := re.match(rf"(?is)\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+|materialized\s+|external\s+)*(table|view|function|procedure)\s+(?:if\s+not\s+exists\s+)?{name}", s[0])):
            own = _slug(path, clean(m[2]))
            if own not in made:
                made.add(own)
                out += [_node(path, clean(m[2]), clean(m[2]) + ("()" if m[1].lower() in ("function", "procedure") else ""), line), _edge(_slug(path), own, "contains", path, line)]
        local = {clean(x) for x in re.findall(rf"(?is)(?:\bwith\b(?:\s+recursive)?|,)\s*{name}\s*(?:\([^()]*\))?\s+as\s*\(", s[0])}
        used = re.findall(rf"(?is)\b(?:from|join|into|update|references)\s+(?:only\s+)?{name}(?![\w$.])(?!\s*\()", s[0]) + re.findall(rf"(?is)\breferences\s+{name}\s*\(", s[0]) + re.findall(rf"(?is)\binto\s+{name}\s*\(", s[0])
        for t in dict.fromkeys(clean(x) for x in used):
            if t not in local and t not in ("select", "set", "values", "lateral", "unnest") and _slug(path, t) != own:
                out.append(_edge(own, _slug(path, t) if _slug(path, t) in made else _slug(t), "references", path, line))
    return out


def manifest_graph(path: str, text: str) -> list[tuple]:
    """A package and what it depends on, of package.json, pyproject.toml, go.mod, pom.xml, requirements.txt; servers of a tools' configuration; keys of other JSON."""
    name = path.rsplit("/", 1)[-1].lower()
    deps: list[str] = []
    title = name
    try:
        if name == "package.json":
            d = json.loads(text)
            title = d.get("name") or name
            deps = [k for s in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies") for k in (d.get(s) or {})]
        elif name == "pyproject.toml":
            import tomllib

            d = tomllib.loads(text)
            p = d.get("project") or {}
            title = p.get("name") or (d.get("tool", {}).get("poetry", {}).get("name")) or name
            lists = [*(p.get("dependencies") or []), *[x for xs in (p.get("optional-dependencies") or {}).values() for x in xs]]
            deps = [re.match(r"[\w.-]+", x)[0] for x in lists if re.match(r"[\w.-]+", x)] + [k for k in (d.get("tool", {}).get("poetry", {}).get("dependencies") or {}) if k != "python"]
        elif name == "go.mod":
            title = (re.search(r"(?m)^module\s+(\S+)", text) or [name, name])[1]
            deps = re.findall(r"(?m)^\s*(?:require\s+)?([\w.-]+\.[\w./-]+)\s+v\S+", text)
        elif name == "pom.xml":
            root = ElementTree.fromstring(text)
            title = next((e.text for e in root if _local(e.tag) == "artifactId"), name)
            deps = [a.text for e in root.iter() if _local(e.tag) == "dependency" for a in e if _local(a.tag) == "artifactId" and a.text]
        elif name.startswith("requirements") and name.endswith(".txt"):
            deps = re.findall(r"(?m)^\s*([A-Za-z0-9][\w.-]*)", text)
        elif name.endswith(".json"):
            d = json.loads(text)
            servers = d.get("mcpServers") if isinstance(d, dict) else None
            own = _slug(path)
            if isinstance(servers, dict):
                out = [_node(path, "", name, 1)]
                for k, v in servers.items():
                    out += [_node(path, k, k, 1), _edge(own, _slug(path, k), "contains", path, 1)]
                    if isinstance(v, dict):
                        out += [_edge(_slug(path, k), _slug(str(v["command"]).rsplit("/", 1)[-1]), "uses", path, 1)] if v.get("command") else []
                        out += [_edge(_slug(path, k), _slug("env", e), "requires_env", path, 1) for e in (v.get("env") or {})]
                return out
            keys = list(d) if isinstance(d, dict) else []
            return [_node(path, "", name, 1), *[x for k in keys for x in (_node(path, k, k, 1), _edge(own, _slug(path, k), "contains", path, 1))]]
    except (ValueError, ElementTree.ParseError):
        return [_node(path, "", name, 1)]
    return [_node(path, "", title, 1), *[_edge(_slug(path), _slug("pkg", x), "depends_on", path, 1) for x in dict.fromkeys(deps)]]


def python_graph(path: str, text: str) -> list[tuple]:
    """The module, its classes, functions and methods, bases, imports, and calls of names of the module; other calls are inferred by name."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return [_node(path, "", path.rsplit("/", 1)[-1], 1)]
    mod = _slug(path)
    out = [_node(path, "", path.rsplit("/", 1)[-1], 1)]
    known: dict[str, str] = {}
    calls: list[tuple[str, str, int]] = []

    def called(body: ast.AST, own: str) -> None:
        for x in ast.walk(body):
            if isinstance(x, ast.Call):
                f = x.func
                if isinstance(f, ast.Name):
                    calls.append((own, f.id, x.lineno))
                elif isinstance(f, ast.Attribute):
                    calls.append((own, f.attr, x.lineno))

    def walk(body: list, outer: str, prefix: str, relation: str) -> None:
        for x in body:
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                own = _slug(path, prefix + x.name)
                known.setdefault(x.name, own)
                out.extend([_node(path, prefix + x.name, ("." if relation == "method" else "") + x.name + "()", x.lineno), _edge(outer, own, relation, path, x.lineno)])
                if (doc := ast.get_docstring(x)):
                    out.extend([(own + "_rationale", doc.split("\n")[0][:120], path, f"L{x.lineno}", "rationale", None, None, None), _edge(own + "_rationale", own, "rationale_for", path, x.lineno)])
                called(x, own)
            elif isinstance(x, ast.ClassDef):
                own = _slug(path, prefix + x.name)
                known.setdefault(x.name, own)
                out.extend([_node(path, prefix + x.name, x.name, x.lineno), _edge(outer, own, "contains", path, x.lineno)])
                out.extend(_edge(own, b.id, "inherits", path, x.lineno) for b in x.bases if isinstance(b, ast.Name))
                walk(x.body, own, f"{prefix}{x.name}.", "method")

    walk(tree.body, mod, "", "contains")
    for x in ast.walk(tree):
        if isinstance(x, ast.Import):
            out.extend(_edge(mod, _slug(a.name), "imports", path, x.lineno) for a in x.names)
        elif isinstance(x, ast.ImportFrom):
            out.append(_edge(mod, _slug("." * x.level + (x.module or "")), "imports_from", path, x.lineno))
    out = [(*r[:5], known.get(r[5], _slug(r[5])), *r[6:]) if r[6] == "inherits" else r for r in out]
    for own, name, line in dict.fromkeys(calls):
        if name in known and known[name] != own:
            out.append(_edge(own, known[name], "calls", path, line, "EXTRACTED"))
    return out


#: Who reads which ending; a further language is one more entry.
GRAPHS: dict[str, Callable[[str, str], list[tuple]]] = {"md": markdown_graph, "mdx": markdown_graph, "sql": sql_graph, "py": python_graph, "json": manifest_graph, "toml": manifest_graph, "mod": manifest_graph, "xml": manifest_graph}


def code_graph(texts: DataFrame, readers: dict[str, Callable[[str, str], list[tuple]]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(id, label, source_file, source_location, file_type)`` and edges ``(source, target, relation, confidence, source_file, source_location)`` of
    files ``(path, texto)``. Files are read one by one, wherever they lie; names across files are for ``resolve_names`` and ``build_graph``."""
    own = readers or GRAPHS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in GRAPH.split(", ")]
        for b in batches:
            got = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                reader = own.get(path.rsplit(".", 1)[-1].lower())
                if path.rsplit("/", 1)[-1].lower().startswith("requirements") and path.endswith(".txt"):
                    reader = own.get("toml")
                if reader and text is not None:
                    got += reader(path, text)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], pa.string()) for i in range(len(names))], names)

    g = texts.select("path", "texto").mapInArrow(run, GRAPH)
    nodes = g.where("relation IS NULL").select("id", "label", "source_file", "source_location", "file_type")
    edges = g.where("relation IS NOT NULL").select(F.col("id").alias("source"), "target", "relation", "confidence", "source_file", "source_location")
    return nodes, edges
