"""Site settings, the arguments every collection job shares."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    tracking_enabled: bool = True
    respect_dnt: bool = False
    respect_gpc: bool = True
    gpc_action: str = "cookieless"  # or "stop"
    privacy_mode: str = "cookieless"  # or "enhanced"
    excluded_ips: tuple[str, ...] = ()
    excluded_paths: tuple[str, ...] = ()
    excluded_roles: tuple[str, ...] = ("administrator", "editor")
    hosts: tuple[str, ...] = ()  # own hosts without www.
    session_timeout_minutes: int = 30
    base_currency: str = "USD"
    heatmaps: bool = True
    identity_params: tuple[str, ...] | None = None  # query parameters that name a page; None: the built-in ones
    site: str = ""
    site_salt: str = ""
    channel_rules: dict = field(default_factory=dict)
