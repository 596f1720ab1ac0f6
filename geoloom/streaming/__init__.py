"""Spatial operators on streams: stateless joins with static shapes, windows with watermarks."""
