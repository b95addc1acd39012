"""Column layout of the index tables."""

FILES = ("path string, language string, content_hash string, mtime_ns long, size_bytes long, "
         "indexed_at_ns long, parse_error_count int")

SYMBOLS = ("sym_id string, path string, parent_id string, symbol_key string, qualified_name string, "
           "name string, kind string, visibility string, signature string, docstring string, "
           "start_byte int, end_byte int, start_line int, end_line int, "
           "signature_start_byte int, signature_end_byte int, body_start_byte int, body_end_byte int")

OCCURRENCES = ("occ_id string, path string, enclosing_id string, spelling string, role string, "
               "start_byte int, end_byte int, start_line int, end_line int, receiver string")

RESOLVED = OCCURRENCES + ", target_id string, resolution_kind string, confidence double"

DOCS = ("doc_id string, path string, parent_id string, heading_level int, heading string, "
        "heading_path array<string>, content string, start_byte int, end_byte int, "
        "start_line int, end_line int")

SOURCES = "path string, content binary, size_bytes long, mtime_ns long"

INDEX_TABLES = ("files", "symbols", "occurrences", "docs")
VERSION = "1.0.0"
