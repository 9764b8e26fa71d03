"""Folders of files for tests."""


def write_files(root, files):
    """Write `files`, contents by name, below the path `root` and return it as text."""
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode("utf-8"))
    return str(root)
