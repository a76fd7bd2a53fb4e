"""The engine's outer surface: facade, instances, configuration, frames and shell."""
