"""Rules and lines shared by the tests."""

RULE_SCHEMA = (
    "component string, component_type string, dir string, file_regex string, start_regex string, min_level string, "
    "max_bytes bigint, delete_after boolean"
)


def line(i, day=2):
    return f"2024-05-{day:02d}T{i % 12:02d}:00:{i % 60:02d}.000Z [INFO] (main) app: (seq: {i})\n"


def rule(component, directory, **more):
    row = {
        "component": component, "component_type": "user", "dir": str(directory), "file_regex": r"\.log",
        "min_level": "INFO", "delete_after": False, **more,
    }
    return tuple(row.get(c.split()[0]) for c in RULE_SCHEMA.split(", "))
