"""Word lists, lookup tables and limits that decide results.

Everything here is data. The logic that uses it lives in ``functions`` and
``operators``.
"""

# File extension -> language.
LANGUAGE_BY_EXTENSION = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "vue": "javascript", "svelte": "javascript",
    "py": "python", "pyi": "python",
    "java": "java", "kt": "kotlin", "kts": "kotlin", "scala": "scala",
    "go": "go", "rs": "rust",
    "c": "c", "h": "c",
    "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp",
    "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "dart": "dart",
    "md": "markdown", "mdx": "markdown", "rst": "markdown",
    "json": "json", "yml": "yaml", "yaml": "yaml", "toml": "toml",
    "html": "html", "htm": "html",
    "css": "css", "scss": "css", "sass": "css", "less": "css",
    "sql": "sql", "sh": "shell", "bash": "shell", "zsh": "shell", "txt": "text",
}

# Languages of files that are known by name, with or without an extension.
LANGUAGE_BY_NAME = {
    "dockerfile": "shell", "makefile": "shell", "readme": "markdown", "license": "text",
}

# Languages that count as code.
CODE_LANGUAGES = [
    "typescript", "javascript", "python", "java", "kotlin", "go", "rust", "c", "cpp",
    "csharp", "ruby", "php", "swift", "scala", "dart",
]

# Code languages whose blocks are delimited by braces.
BRACE_LANGUAGES = [
    "typescript", "javascript", "java", "kotlin", "go", "rust", "c", "cpp", "csharp",
    "php", "swift", "scala", "dart",
]

# Directories that are never scanned.
IGNORED_DIRECTORIES = """
.git node_modules dist build out .next .nuxt coverage vendor __pycache__ .venv venv env .tox
.mypy_cache .pytest_cache target bin obj .idea .vscode .gradle Pods .turbo .cache tmp .svelte-kit
site-packages bower_components .terraform third_party external
""".split()

# Lock files that are never scanned.
IGNORED_FILES = """
package-lock.json yarn.lock pnpm-lock.yaml poetry.lock Cargo.lock go.sum composer.lock
Gemfile.lock bun.lockb
""".split()

# First path segments that do not name a module by themselves.
CONVENTIONAL_ROOTS = """
src lib app packages pkg internal cmd source apps modules services components
""".split()

# Source roots probed when an import is not relative.
SOURCE_ROOTS = ["src", "lib", "app", "source", "pkg", "packages"]

# Extensions tried for a JavaScript or TypeScript import, in order.
SCRIPT_EXTENSIONS = [
    ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".vue", ".svelte", ".d.ts",
]
# Typed extensions that stand in for an emitted script extension.
TYPED_EXTENSIONS = [".ts", ".tsx", ".mts", ".cts"]

# Modules that ship with the Node runtime.
NODE_BUILTINS = """
fs path os http https crypto url util events stream child_process zlib net tls dns buffer assert
readline worker_threads cluster querystring timers vm perf_hooks process
""".split()

# Words that are not search terms.
STOP_WORDS = """
the a an and or of to in is it for on with as by at be this that are was from how what where which
who does do can i me my we our you your if then else return const let var def function class import
export new self this true false null none undefined public private static void int string about
explain show tell work works code file files repo repository please there when why into used use
""".split()

# Names in call position that are not treated as calls.
CALL_STOP_WORDS = """
if for while switch catch return function typeof sizeof await yield new super this self print
println printf len range str int float list dict set tuple bool isinstance console require import
assert elif with lambda not and or in is fn match loop defer go make append panic delete void var
let const def class struct Some Ok Err None vec format String Object Array Promise Error Map Set
Math JSON Number Boolean Symbol parseInt parseFloat setTimeout setInterval clearTimeout then
finally push pop map filter reduce forEach join split slice splice keys values entries get has add
toString log error warn info debug includes indexOf replace trim length concat sort find some every
resolve reject emit on off extend items update copy insert remove open close read write exists min
max abs round sum any all zip enumerate sorted reversed getattr setattr hasattr type id hash iter
next
""".split()

# Keywords that look like a declaration or a call but are control flow.
CONTROL_WORDS = """
if for while switch catch return new else do try finally function synchronized throw case sizeof
typeof await yield delete using lock foreach elif when match loop unless until defer go select
constructor_ super this import export require assert print println
""".split()

# Plain words that never identify a symbol in a question.
COMMON_WORDS = """
handle handler request response options config settings process result update create delete remove
render parse format string number object values export import module client server service method
function return change impact should happens startup architecture between without please explain
where which
""".split()

# Path patterns of test files. The first four ignore case.
TEST_PATH_PATTERNS = [
    r"(?i)(^|/)(__tests__|tests?|spec|specs)/",
    r"(?i)[._-](test|spec)\.[a-z0-9]+$",
    r"(?i)(^|/)test_[^/]+\.py$",
    r"(?i)_test\.(go|py)$",
    r"Tests?\.(java|kt|cs|swift)$",
]

# Test directories that lower a retrieval score.
TEST_DIRECTORY_PATTERN = r"(?i)(^|/)(test|tests|__tests__|spec)/"

# Files that start a program and are never "unused".
ENTRY_POINT_PATTERN = (
    r"(?i)(^|/)(index|main|app|server|cli|__main__|__init__|setup|manage|program|mod|lib|page|"
    r"layout|route|middleware|config)\.[a-z]+$"
)

# Function names that a framework or runtime calls.
SPECIAL_FUNCTION_PATTERN = (
    r"^(main|constructor|init|__\w+__|render|setup|teardown|handle\w*|on[A-Z]\w*|get|post|put|"
    r"patch|delete|default|toString|equals|hashCode|run|execute|apply|call|invoke|test\w*|it|"
    r"describe|beforeEach|afterEach|configure|register|build|new|drop|fmt|from|into|serve|"
    r"ServeHTTP|Main|Dispose|OnModelCreating|ngOnInit|componentDidMount)$"
)

# Token shapes looked for in a question.
IDENTIFIER_MENTION_PATTERN = r"[A-Za-z_$][\w$]*(?:\.[\w$]+)*"
PATH_MENTION_PATTERN = r"(?i)[\w./-]+\.[a-z]{1,5}\b"
SEARCH_WORD_PATTERN = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+"

# Okapi weights, fusion constant and list weights of the retrieval.
BM25_K1 = 1.4
BM25_B = 0.72
FUSION_OFFSET = 60
LIST_WEIGHTS = {"keyword": 1.0, "semantic": 1.1, "graph-match": 1.3, "graph-neighbour": 0.55}
LIST_LENGTH = 40

# Chunk geometry.
CHUNK_WINDOW = 60
CHUNK_OVERLAP = 8
CHUNK_MAX_ENTITY = 120
CHUNK_MIN_CHARS = 20
