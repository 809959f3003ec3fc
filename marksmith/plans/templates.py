"""Prompt templates (each has exactly one ``{}`` slot)."""

# The two templates the checking step uses by default.
CHECK_TEMPLATES = [
    "{}",
    "You are a helpful AI assistant. Answer the following. {}",
]

# Our own small augmentation set (sample data, not the original file).
AUGMENT_TEMPLATES = [
    "{}",
    "Please respond to this: {}",
    "System: stay concise.\nUser: {}",
    "Q: {} A:",
    "Read carefully. {} Reply briefly.",
    "[note] {}",
]


def sql_values(templates: list[str]) -> str:
    rows = ", ".join(f"({i}, '{t.replace(chr(39), chr(39) * 2)}')" for i, t in enumerate(templates))
    return f"(VALUES {rows}) AS tpl(template_id, template)"
