"""Results depend on them, so they are stated plainly and together."""

SKIP_DIRS = frozenset(
    ".git .svn .hg .idea .vs .vscode node_modules __pycache__ .mypy_cache .pytest_cache .ruff_cache "
    "build dist bin obj out target venv .venv env .tox .eggs site-packages".split()
)
SEARCHABLE_EXTS = frozenset(
    ".py .pyi .pyw .js .jsx .ts .tsx .mjs .cjs .c .h .cpp .hpp .cc .cxx .hxx .hh .inl .cs .java .kt .kts .scala .swift .m .mm "
    ".go .rs .rb .php .lua .dart .ex .exs .sh .bash .zsh .ps1 .bat .cmd .sql .r .jl .hs .ml .clj .vim "
    ".txt .md .rst .json .yaml .yml .toml .ini .cfg .conf .xml .html .css .scss .less".split()
)
PYTHON_EXTS = frozenset(".py .pyi .pyw".split())
C_LIKE_EXTS = frozenset(".c .h .cpp .hpp .cc .cxx .hxx .hh .inl .cs .java .kt .scala .go .rs .swift .m .mm .js .ts .jsx .tsx .php .rb .lua .dart".split())
MAX_FILE_BYTES = 1_000_000

#: Line ends that a text is split at.
LINE_ENDS = "\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029"

DEFINITION = r"^\s*(?:export\s+)?(?:pub\s+)?(?:static\s+)?(?:async\s+)?(?:def|class|fn|func|function|impl|trait|interface|struct|enum|type)\b"
PYTHON_HEADER = r"^(\s*)(?:async\s+def\s|def\s|class\s)"
SYMBOL_AFTER_KEYWORD = r"(?:class|struct|enum|def|fn|func|function|proc|method|impl|trait|interface|void|int|char|bool|auto|static|virtual|const)\s+(\w+)"
SYMBOL_BEFORE_PAREN = r"\b(\w+)\s*\("
KIND_WORDS = "class struct def fn func function proc void int char bool auto impl trait".split()
VENDOR_PARTS = "vendor node_modules __pycache__ .git build dist generated auto-generated .min.js .bundle".split()
C_LIKE_OPEN = (
    r"^\s*(?:(?:static|virtual|const|inline|unsigned|signed|extern|template|public|private|protected|friend|explicit|constexpr|noexcept"
    r"|decltype|auto|void|int|char|bool|float|double|size_t|uint\w+|int\w+|class|struct|enum|union|namespace)\s+)*"
    r"(?:class|struct|enum|union|namespace|if|else|for|while|do|switch|case|try|catch|finally|with|def|fn|func|function|proc|method|impl|trait"
    r"|interface|type|module|package)\b"
)
C_LIKE_CLOSE = r"^\s*[\}\)]"
PHRASE_STOP = frozenset(
    "the a an and or of to in for with when where how why what which does do did is are was were be been should could would can will my our "
    "this that these those it its on at by from into over under not no if then than so make makes made use uses using get gets sets set".split()
)
SYMBOL_STOP = frozenset("import return yield raise assert lambda global nonlocal print super self None True False class match case while elif else except finally".split())
STEM_SUFFIXES = ("ation", "izing", "ized", "ing", "ies", "ion", "ers", "ed", "es", "er", "s")

BM25_K1, BM25_B = 1.2, 0.75
RERANK_HEAD, RECALL_TOP = 250, 40
NEAR_DUP = 0.7
ALPHA_TEXT, BETA_CHURN, GAMMA_COCHANGE = 1.0, 0.3, 0.5
CHURN_DAYS = 90.0
ROUTER_WEIGHTS = (-2.0264, 1.4161, 0.3591, -1.2606, -1.2075, -0.0575, -0.8742)
