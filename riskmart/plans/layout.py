"""Where the tables of one mart live."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Mart:
    root: str

    def _at(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])

    def bronze(self, name: str) -> str:
        return self._at("bronze", name)

    def silver(self, name: str) -> str:
        return self._at("silver", name)

    def losses(self, name: str) -> str:
        return self._at("losses", name)

    @property
    def ledger(self) -> str:
        return self._at("ledger")

    @property
    def label_store(self) -> str:
        return self._at("gold", "label_store")

    @property
    def feature_store(self) -> str:
        return self._at("gold", "feature_store")

    @property
    def vocabulary(self) -> str:
        return self._at("gold", "vocabulary")

    @property
    def predictions(self) -> str:
        return self._at("gold", "model_predictions")

    @property
    def performance(self) -> str:
        return self._at("gold", "performance_metrics")

    @property
    def drift_bins(self) -> str:
        return self._at("gold", "drift_bins")

    @property
    def drift_log(self) -> str:
        return self._at("gold", "feature_drift_psi")

    @property
    def drift_flags(self) -> str:
        return self._at("gold", "drift_flags")

    @property
    def model_bank(self) -> str:
        return self._at("model_bank")
