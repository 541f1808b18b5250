"""Values that results depend on."""

# Stop words of the lexical index.
INDEX_STOP_WORDS = """
i me my myself we our ours you your he him his she her it its they them their what which who whom
this that these those am is are was were be been being have has had having do does did doing a an
the and but if or because as until while of at by for with about against between through during before
after above below to from up down in out on off over under again further then once here there when
where why how all both each few more most other some such no nor not only own same so than too
very s t can will just don should now
el la los las un una de del en y o que por para con sin se lo mi tu su es son tiene han
""".split()

# Stop words of retrieval queries.
RETRIEVAL_STOP_WORDS = """
i me my myself we our ours you your he him his she her it its they them their what which who whom
this that these those am is are was were be been being have has had having do does did doing a an
the and but if or because as until while of at by for with about against between through during before
after above below to from up down in out on off over under again further then once here there when
where why how all both each few more most other some such no nor not only own same so than too very
el la los las un una de del en y o que por para con sin se lo mi tu su es son
""".split()

# Stop words of keyword searches.
SEARCH_STOP_WORDS = """
a about all an and are as at be con de del did do el en es for from how i la las lo los me mi mis my
of on or para por que the this to un una what with y
""".split()

# Stop words of chunk keywords.
KEYWORD_STOP_WORDS = "this that with from have been were they their there would could should".split()

# Query expansion of the lexical index (a keyword anywhere in the query; the first counts).
INDEX_EXPANSIONS = {
    "age": ["birth", "born", "year", "old"],
    "project": ["repo", "github", "code", "app", "bot", "service"],
    "work": ["task", "build", "implement", "fix", "feature", "code"],
    "fan": ["pwm", "thermal", "cooling", "temperature", "heat"],
    "model": ["llm", "ai", "qwen", "gpt", "inference", "gguf"],
}

# Query expansion of retrieval (equal terms).
RETRIEVAL_EXPANSIONS = {
    "docker": ["container", "podman", "deploy"],
    "gpu": ["nvidia", "cuda", "vram"],
    "database": ["sqlite", "db", "postgres"],
    "server": ["api", "http", "backend"],
    "ai": ["llm", "model", "inference", "embedding"],
    "project": ["repo", "codebase", "app", "bot"],
    "fan": ["cooling", "thermal", "temperature", "pwm"],
    "android": ["mobile", "kotlin", "app"],
    "hardware": ["cpu", "ram", "gpu", "device"],
    "network": ["dns", "proxy", "ip"],
    "deploy": ["docker", "production", "release"],
    "model": ["llm", "gguf", "inference", "qwen"],
}

# Category keywords by input format, in order of precedence.
CATEGORY_KEYWORDS = {
    "jsonl": {"code": ["def ", "class ", "function ", "import ", "code"], "tool": ["tool", "execute", "script", "command"], "reasoning": ["think", "reason", "analysis", "consider"]},
    "normalized": {"code": ["def ", "class ", "function ", "import ", "code"], "tool": ["tool", "execute", "script", "command"], "reasoning": ["reason", "analysis", "consider"]},
    "factory": {"code": ["def ", "class ", "function ", "import ", "code"], "tool": ["tool", "execute", "script", "command"], "reasoning": ["analysis", "think", "reason"]},
    "qwen": {"code": ["def ", "class ", "function ", "import ", "code", "script", "python"], "tool": ["tool", "shell", "command", "execute", "run"], "reasoning": ["think", "reason", "analysis", "consider", "plan"]},
    "takeout": {"code": ["def ", "class ", "function ", "import ", "code"], "reasoning": ["think", "reason", "analysis", "consider"]},
}

# Importance by category.
IMPORTANCE = {"code": 0.7, "tool": 0.6, "reasoning": 0.65}

# Needles that mark code in a passage.
CODE_NEEDLES = ["```", "/home/", ".ts", ".kt", "const ", "function ", "=>", "./"]

# What names a tool or a task in a text.
TOOLS = {
    "claude": ["claude", "anthropic", "claude code"],
    "codex": ["codex", "openai codex"],
    "pi": ["pi-brain", "pi mono"],
    "opencode": ["opencode", "open code"],
    "cursor": ["cursor"],
    "gemini": ["gemini", "google ai"],
    "llama": ["llama.cpp", "llama-server", "llamacpp"],
    "ollama": ["ollama"],
    "vscode": ["vscode", "vscode_tunnel"],
}
TASKS = {
    "bugfix": ["fix", "bug", "error", "crash", "issue", "problem", "broken"],
    "feature": ["feature", "implement", "add", "new", "create"],
    "refactor": ["refactor", "restructure", "reorganize", "cleanup", "clean up"],
    "config": ["config", "setup", "install", "deploy", "environment"],
    "debug": ["debug", "debugging", "trace", "log", "inspect"],
    "research": ["research", "investigate", "explore", "analyze"],
    "testing": ["test", "unit test", "integration test", "pytest"],
    "doc": ["document", "readme", "docs", "write up"],
}

# Line beginnings that a summary skips.
CODE_LINE_STARTS = ["%", "$", "#", "```", "import ", "from ", "const ", "function ", "def ", "{", "}"]

# File extensions that name a file in a text.
FILE_EXTENSIONS = "py js ts json yaml yml md txt sh rs go kt".split()

# Patterns of query types; the order breaks ties.
QUERY_PATTERNS = {
    "temporal": [r"\b(recent|latest|last|yesterday|today|this week|this month)\b", r"\b(recentemente|último|ayer|hoy|esta semana)\b", r"\b(past|ago|before|since|new)\b", r"\b\d+\s+(days?|weeks?|months?|hours?)\s+ago\b"],
    "comparative": [r"\b(compare|versus|vs|difference|between)\b", r"\b(missing|omitted|gap|lacks?)\b", r"\b(what.*(not|isn't|wasn't))\b", r"\b(comparar|diferencia|entre)\b"],
    "analytical": [r"\b(analyze|explain|how does|why does|summarize)\b", r"\b(overview|summary|breakdown|insights?)\b", r"\b(analizar|explicar|resumir|por qué)\b", r"\b(tell me about|describe|overview)\b"],
    "code": [r"\b(code|function|class|method|api|endpoint|module)\b", r"\b(bug|error|fix|debug|implementation)\b", r"\b(import|def |class |const |var |let )\b", r"\b(stack.?trace|exception|traceback)\b"],
    "factual": [r"\b(what is|who is|where is|when (did|was|is))\b", r"\b(how (to|do|many|much))\b", r"\b(define|definition)\b", r"\b(cuando|donde|quien|cuanto|cuál)\b"],
    "personal": [r"\b(i|my|me|mine|we|our)\b", r"\b(have|i.?ve|got|own|use|running)\b", r"\b(tengo|mi |mis |mío|nuestro)\b", r"\b(my (hardware|setup|projects|tools|config|devices))\b"],
}

# Retrieval plan by query type: strategy, times top_k, reranker, vectors, recency.
PLANS = {
    "comparative": ("long_context", 3, True, True, False),
    "factual": ("bm25_only", 1, False, False, False),
    "temporal": ("hybrid", 1, False, True, True),
    "analytical": ("hybrid", 2, True, True, False),
    "personal": ("hybrid", 1, False, True, True),
    "code": ("bm25_only", 1, False, False, False),
    "exploratory": ("hybrid", 1, False, True, True),
}

# Separators of structure-aware chunking and break points of sliding windows, best first.
SEPARATORS = ["\n\n", "\n", ". ", "。", "! ", "? ", "; ", " "]
BREAK_POINTS = ["\n\n", ". ", "。", "\n", "! ", "? "]
CONVERSATIONAL_SOURCES = "pi claude codex gemini droid factory qwen_code opencode cursor".split()

# File types by suffix: file_type, extractor, processable.
FILE_TYPES = {
    ".jsonl": ("jsonl", "jsonl_extractor", True),
    ".zip": ("archive", "archive_extractor", True),
    ".json": ("json", "json_extractor", True),
    ".txt": ("text", "text_extractor", True),
    ".md": ("text", "text_extractor", True),
    ".markdown": ("text", "text_extractor", True),
    ".patch": ("patch", "text_extractor", True),
    ".log": ("log", "none", False),
}
