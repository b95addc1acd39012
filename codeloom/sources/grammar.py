"""Words and statement shapes of the brace languages.

A shape is a statement with its tokens separated by single spaces and every bracket pair
collapsed: ``public void f ( ) { }``. Annotation argument brackets appear as ``~ ~``.
"""

# Words that may precede a declaration.
MODIFIERS = {
    "java": ("public", "protected", "private", "static", "final", "abstract", "sealed", "strictfp", "default",
             "synchronized", "native", "transient", "volatile"),
    "kotlin": ("public", "protected", "private", "internal", "open", "abstract", "sealed", "data", "value", "inner",
               "annotation", "enum", "companion", "override", "suspend", "inline", "operator", "infix", "tailrec",
               "external", "final", "lateinit", "const", "actual", "expect", "noinline", "crossinline"),
    "swift": ("public", "private", "internal", "fileprivate", "open", "final", "static", "override", "mutating",
              "nonmutating", "convenience", "required", "indirect", "lazy", "weak", "async", "nonisolated", "dynamic"),
}

# Words that open a declaration.
DECLARATORS = ("class", "interface", "object", "fun", "val", "var", "typealias", "import", "package", "init",
               "constructor", "struct", "enum", "protocol", "extension", "func", "let", "case", "deinit", "subscript")

# Words that continue a statement on the next line.
CONTINUATIONS = ("else", "catch", "finally", "where", "by", "as", "is", "in", "throws", "rethrows")

# Words whose statement opens a block.
BLOCK_WORDS = ("if", "while", "for", "switch", "when", "guard", "else", "do", "try", "catch", "repeat")

# Words that are never the name of a call.
NOT_CALLS = {
    "java": ("if", "while", "for", "switch", "catch", "new", "class", "super", "this", "return", "throw", "else", "do", "try",
             "synchronized", "assert", "case", "default", "instanceof", "import", "package"),
    "kotlin": ("if", "while", "for", "when", "catch", "class", "super", "this", "return", "throw", "else", "do", "try", "fun",
               "val", "var", "object", "interface", "in", "is", "as", "import", "package", "typealias"),
    "swift": ("if", "while", "for", "switch", "catch", "class", "super", "self", "return", "throw", "else", "do", "try", "func",
              "var", "let", "guard", "defer", "repeat", "in", "is", "as", "where", "case", "default", "import", "enum", "struct",
              "protocol", "extension", "await", "throws"),
}

# Words that name a call only after a dot.
NOT_BARE_CALLS = {
    "java": ("yield",),
    "kotlin": ("get", "set", "init", "constructor", "by", "where", "finally", "companion"),
    "swift": ("get", "set", "init", "deinit", "willSet", "didSet", "subscript"),
}

NAME = r"[\p{L}_$][\p{L}\p{N}_$]*"


def prefix(language: str) -> str:
    """Annotations and modifiers."""
    words = "|".join(MODIFIERS[language])
    return rf"(?:(?:@ {NAME}(?: [.:] {NAME})*(?: ~ ~)?|non - sealed|(?:{words})(?: ~ ~)?) )*"


# Words of which a shape of a type holds one.
TYPE_WORDS = ("class", "interface", "record", "enum", "object", "struct", "protocol", "extension", "actor")

# Statement shapes; group 1 ends right before the declared name.
TYPE_SHAPES = {
    "java": rf"^({prefix('java')}(class|interface|record|enum) )({NAME}) ",
    "kotlin": rf"^({prefix('kotlin')}(?:fun )?(class|interface|object) )({NAME}(?= |$)|(?=[:{{]|$))",
    "swift": rf"^({prefix('swift')}(class|struct|enum|protocol|extension|actor) )({NAME})(?<! func| var| let| subscript)(?= |$)",
}
FUNCTION_SHAPES = {
    "java": rf"^([\p{{L}}\p{{N}}_$.<>,?&\[\]@~ ]*?)({NAME}) \( \)(?: \[ \])*(?: throws [\p{{L}}\p{{N}}_$.,@<> ]+?)?(?: default [^;]*)? (?:\{{ \}}|;)$",
    "kotlin": rf"^({prefix('kotlin')}fun [\p{{L}}\p{{N}}_$<>,?.:*&@ ]*?)({NAME}) \( \)",
    "swift": rf"^({prefix('swift')}(?:class )?func )([^ ]+)(?: <[^(){{}}]*>)? \( \)",
}
CONSTRUCTOR_SHAPES = {
    "kotlin": rf"^({prefix('kotlin')})(constructor) \( \)",
    "swift": rf"^({prefix('swift')})(init)(?: [?!])?(?: <[^(){{}}]*>)? \( \)",
}

# Symbol kind of each declaring word.
KINDS = {"class": "class", "struct": "class", "enum": "class", "object": "class", "interface": "interface",
         "protocol": "interface", "record": "record"}

# Tokens of all three languages; every character belongs to exactly one token.
TOKEN = (r"(?s)/\*.*?(?:\*/|\z)|//[^\n]*"
         r'|"""(?:.*?)(?:"""|\z)'
         r'|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"?'
         r"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'?"
         r"|`[^`\n]+`|" + NAME +
         r"|\p{N}++(?:\.\p{N}++)?[\p{L}\p{N}_]*+|\s++|.")
