"""Outside programs for videos and HEIC pictures: where they are, a container's description, one frame."""

from __future__ import annotations

import os
import shutil
import subprocess
from dataclasses import dataclass

#: Seconds that a call may take; videos longer than LONG give the frame at SEEK seconds, others their first one.
WAIT, LONG, SEEK = 120, 4.0, 2


def find_tool(name: str, beside: str | None = None) -> str | None:
    """The program's path: the copy in the folder ``beside`` if it is a file, else the one on the path if it runs."""
    own = os.path.join(beside, name) if beside else None
    if own and os.path.isfile(own):
        return own
    found = shutil.which(name)
    try:
        return found if found and subprocess.run([found, "-version"], capture_output=True, timeout=WAIT).returncode == 0 else None
    except (OSError, subprocess.TimeoutExpired):
        return None


@dataclass(frozen=True)
class Tools:
    """Paths of the two programs as executors see them; None where there is none."""

    frames: str | None = None
    probe: str | None = None

    @classmethod
    def found(cls, beside: str | None = None) -> Tools:
        return cls(find_tool("ffmpeg", beside), find_tool("ffprobe", beside))

    def describe(self, path: str) -> str | None:
        """The container's description as JSON, or None."""
        try:
            return subprocess.run([self.probe, "-v", "quiet", "-print_format", "json", "-show_format", "-show_streams", path], capture_output=True, timeout=WAIT).stdout.decode("utf-8", "replace") or None
        except (OSError, subprocess.TimeoutExpired):
            return None

    def frame(self, path: str, seconds: float | None) -> bytes:
        """One frame as the bytes of a BMP file; nothing is left on disk."""
        seek = SEEK if seconds is not None and seconds > LONG else 0
        got = subprocess.run([self.frames, "-v", "error", "-ss", str(seek), "-i", path, "-frames:v", "1", "-f", "image2pipe", "-c:v", "bmp", "-"], capture_output=True, timeout=WAIT)
        if got.returncode or not got.stdout:
            raise ValueError(f"no frame: {got.stderr.decode('utf-8', 'replace')[-300:]}")
        return got.stdout
