"""Options of an analysis, with the checks that a user's values must pass."""

from __future__ import annotations

from dataclasses import dataclass, field

from .operators.scoring import DEFAULT_WEIGHTS


class OptionError(ValueError):
    pass


REQUIRED_WEIGHTS = ("fan_in", "fan_out", "complexity", "churn", "coverage")
OPTIONAL_WEIGHTS = {"interaction": 0.0, "coupling": 0.05}


def parse_weights(text: str) -> dict[str, float]:
    """`name:value` pairs, comma-separated. The two optional weights have defaults of their own here."""
    out: dict[str, float] = {}
    for entry in text.split(","):
        name, colon, value = entry.partition(":")
        if not (name and colon and value):
            raise OptionError("Error: invalid weights format.")
        try:
            out[name] = float(value)
        except ValueError:
            raise OptionError("Error: weight values must be floats.") from None
    if not set(REQUIRED_WEIGHTS) <= set(out) <= {*REQUIRED_WEIGHTS, *OPTIONAL_WEIGHTS}:
        raise OptionError("Error: weights must include fan_in, fan_out, complexity, churn, and coverage.")
    out = {**OPTIONAL_WEIGHTS, **out}
    if any(not 0 <= w <= 1 for w in out.values()):
        raise OptionError("Error: weight values must be between 0.0 and 1.0.")
    return out


@dataclass
class Options:
    churn_days: int = 180
    weights: dict[str, float] = field(default_factory=lambda: dict(DEFAULT_WEIGHTS))
    custom_weights: bool = False
    ruby_coverage: str | None = None
    js_coverage: str | None = None
    js_timeout: int = 60
    rails_inference: bool = True
    trunk_threshold: int = 85
    branch_threshold: int = 50
    exclude: list[str] = field(default_factory=list)
    min_files: int = 20
    top: int | None = None
    diff_base: str | None = None
    only_paths: list[str] | None = None
    coupling_threshold: float = 0.30
    coupling_min_commits: int = 5
    coupling_max_commit_files: int = 50
    new_file_days: int = 30
    new_file_min_commits: int = 3
    newness: bool = True
    #: Epoch seconds that ages count to.
    as_of: int = 0

    def validate(self) -> Options:
        for name in ("trunk_threshold", "branch_threshold"):
            if not 1 <= getattr(self, name) <= 99:
                raise OptionError(f"Error: {name.replace('_', '-')} must be between 1 and 99.")
        tests = (
            (self.branch_threshold < self.trunk_threshold, "branch-threshold must be strictly less than trunk-threshold."),
            (self.min_files > 0, "--min-files must be positive."),
            (self.top is None or self.top > 0, "--top must be positive."),
            (self.churn_days > 0, "--churn-days must be positive."),
            (self.js_timeout > 0, "--js-timeout must be positive."),
            (self.new_file_days >= 0, "--new-file-days must be zero or positive."),
            (self.new_file_min_commits >= 0, "--new-file-min-commits must be zero or positive."),
            (self.coupling_min_commits > 0, "--coupling-min-commits must be positive."),
            (self.coupling_max_commit_files >= 0, "--coupling-max-commit-files must be zero or positive."),
            (0 <= self.coupling_threshold <= 1, "--coupling-threshold must be between 0.0 and 1.0."),
            (not (self.diff_base and self.only_paths), "--diff-base and --only are mutually exclusive."),
        )
        for ok, text in tests:
            if not ok:
                raise OptionError(f"Error: {text}")
        if self.custom_weights:
            self._validate_weights()
        return self

    def _validate_weights(self) -> None:
        if any(not 0 <= w <= 1 for w in self.weights.values()):
            raise OptionError("Error: weight values must be between 0.0 and 1.0.")
        if not (self.ruby_coverage or self.js_coverage):
            for name in ("coverage", "interaction"):
                if self.weights.get(name, 0) > 0:
                    raise OptionError(f"Error: {name} weight must be 0.0 when no coverage data is provided.")
        total = sum(self.weights.values())
        if abs(total - 1) > 0.001:
            raise OptionError(f"Error: weights must sum to 1.0; actual sum is {total:.4f}.")


def formula(*, coverage: bool, coupling: float | None) -> str:
    return ("5-factor" if coverage else "4-factor") + (" + coupling" if coupling and coupling > 0 else "")
