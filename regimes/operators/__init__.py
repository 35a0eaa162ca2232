"""The engine's operators over long series, windows and metrics."""
