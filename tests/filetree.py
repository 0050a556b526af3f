"""Files that the tests write themselves."""

import os


def write_files(folder: str, files: dict[str, bytes | str]) -> str:
    for name, content in files.items():
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        data = content.encode("utf-8") if isinstance(content, str) else content
        with open(path, "wb") as fh:
            fh.write(data)
    return folder
