"""Permutation generators: programs that print the permutations of a domain as JSON."""

from __future__ import annotations

import subprocess
from collections.abc import Callable


def command_generator(command: str, timeout: float = 120.0) -> Callable[[str], str]:
    """The output of ``command --format json --registered DOMAIN``; a timeout and an exit code other than 0 are errors."""

    def generate(domain: str) -> str:
        done = subprocess.run([command, "--format", "json", "--registered", domain], capture_output=True, text=True, timeout=timeout, check=False)
        if done.returncode:
            raise RuntimeError(done.stderr.strip() or done.stdout.strip() or f"exit code {done.returncode}")
        return done.stdout

    return generate
