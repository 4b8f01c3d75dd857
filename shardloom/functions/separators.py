"""Separator chains by language: declarations first, then blank lines, lines, words, characters."""

from __future__ import annotations

# The chain of each key, in the order in which separators are tried.
CHAINS: dict[str, list[str]] = {
    "js": ["\nfunction ", "\nconst ", "\nlet ", "\nvar ", "\nclass ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ", "\ncase ", "\ndefault ", "\n\n",
        "\n", " ", ""],
    "python": ["\nclass ", "\ndef ", "\n\tdef ", "\n\n", "\n", " ", ""],
    "java": ["\nclass ", "\npublic ", "\nprotected ", "\nprivate ", "\nstatic ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ", "\ncase ", "\n\n", "\n",
        " ", ""],
    "c": ["\nclass ", "\nvoid ", "\nint ", "\nfloat ", "\ndouble ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ", "\ncase ", "\n\n", "\n", " ", ""],
    "go": ["\nfunc ", "\nvar ", "\nconst ", "\ntype ", "\nif ", "\nfor ", "\nswitch ", "\ncase ", "\n\n", "\n", " ", ""],
    "rust": ["\nfn ", "\nconst ", "\nlet ", "\nif ", "\nwhile ", "\nfor ", "\nloop ", "\nmatch ", "\n\n", "\n", " ", ""],
    "php": ["\nfunction ", "\nclass ", "\nif ", "\nforeach ", "\nwhile ", "\ndo ", "\nswitch ", "\ncase ", "\n\n", "\n", " ", ""],
    "ruby": ["\ndef ", "\nclass ", "\nif ", "\nunless ", "\nwhile ", "\nfor ", "\ndo ", "\nbegin ", "\nrescue ", "\ncase ", "\n\n", "\n", " ", ""],
    "swift": ["\nfunc ", "\nclass ", "\nstruct ", "\nenum ", "\nactor ", "\nif ", "\nfor ", "\nwhile ", "\ndo ", "\nswitch ", "\ncase ", "\n\n",
        "\n", " ", ""],
    "scala": ["\nclass ", "\nobject ", "\ndef ", "\nval ", "\nvar ", "\nif ", "\nfor ", "\nwhile ", "\nmatch ", "\ncase ", "\n\n", "\n", " ", ""],
    "csharp": ["\ninterface ", "\nenum ", "\nimplements ", "\ndelegate ", "\nevent ", "\nclass ", "\nabstract ", "\npublic ", "\nprotected ",
        "\nprivate ", "\nstatic ", "\nreturn ", "\nif ", "\ncontinue ", "\nfor ", "\nforeach ", "\nwhile ", "\nswitch ", "\nbreak ", "\ncase ",
        "\n\n", "\n", " ", ""],
    "html": ["<body", "<div", "<p", "<br", "<li", "<h1", "<h2", "<h3", "<h4", "<h5", "<h6", "<span", "<table", "<tr", "<td", "<th", "<ul", "<ol",
        "<header", "<footer", "<nav", "<head", "<style", "<script", "<meta", "<title", ""],
    "markdown": ["\n## ", "\n### ", "\n#### ", "\n##### ", "\n###### ", "```\n\n", "\n\n***\n\n", "\n\n---\n\n", "\n\n___\n\n", "\n\n", "\n", " ",
        ""],
    "latex": ["\n\\chapter{", "\n\\section{", "\n\\subsection{", "\n\\subsubsection{", "\n\\begin{enumerate}", "\n\\begin{itemize}",
        "\n\\begin{description}", "\n\\begin{list}", "\n\\begin{quote}", "\n\\begin{quotation}", "\n\\begin{verse}", "\n\\begin{verbatim}",
        "\n\\begin{align}", "$$", "$", " ", ""],
    "solidity": ["\npragma ", "\nusing ", "\ncontract ", "\ninterface ", "\nlibrary ", "\nconstructor ", "\ntype ", "\nfunction ", "\nevent ",
        "\nmodifier ", "\nerror ", "\nstruct ", "\nenum ", "\nif ", "\nfor ", "\nwhile ", "\ndo while ", "\nassembly ", "\n\n", "\n", " ", ""],
    "kotlin": ["\nfun ", "\nclass ", "\nobject ", "\ninterface ", "\ndata class ", "\nsealed class ", "\nenum class ", "\nval ", "\nvar ", "\nif ",
        "\nfor ", "\nwhile ", "\nwhen ", "\n\n", "\n", " ", ""],
    "objc": ["\n@interface ", "\n@implementation ", "\n@protocol ", "\n@property ", "\n- (", "\n+ (", "\nif ", "\nfor ", "\nwhile ", "\nswitch ",
        "\n\n", "\n", " ", ""],
    "dart": ["\nclass ", "\nabstract class ", "\nenum ", "\nmixin ", "\nextension ", "\ntypedef ", "\nvoid ", "\nFuture", "\nStream", "\nif ",
        "\nfor ", "\nwhile ", "\nswitch ", "\n\n", "\n", " ", ""],
    "bash": ["\nfunction ", "\n# ", "\nif ", "\nfor ", "\nwhile ", "\nuntil ", "\ncase ", "\n\n", "\n", " ", ""],
    "json": ["\n\n", "\n  \"", "\n\t\"", "\n", " ", ""],
    "css": ["\n\n", "}\n", "\n", " ", ""],
    "": ["\n\n", "\n", " ", ""],
}

# Language ids and aliases of each key.
ALIASES: dict[str, list[str]] = {
    "js": ["javascript", "js", "typescript", "ts", "jsx", "tsx"],
    "python": ["python", "py"],
    "java": ["java"],
    "c": ["cpp", "c++", "c"],
    "go": ["go"],
    "rust": ["rust", "rs"],
    "php": ["php"],
    "ruby": ["ruby", "rb"],
    "swift": ["swift"],
    "scala": ["scala"],
    "csharp": ["csharp", "cs"],
    "html": ["html"],
    "markdown": ["markdown", "md"],
    "latex": ["latex", "tex"],
    "solidity": ["solidity", "sol"],
    "kotlin": ["kotlin", "kt", "kts"],
    "objc": ["objective-c", "objc", "objectivec"],
    "dart": ["dart"],
    "bash": ["bash", "sh", "shell"],
    "json": ["json"],
    "css": ["css", "scss"],
}
KEY_OF = {alias: key for key, aliases in ALIASES.items() for alias in aliases}


def chain_for(language: str | None) -> list[str]:
    return CHAINS[KEY_OF.get((language or "").lower(), "")]
