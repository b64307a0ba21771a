"""The same jobs on streams: archive in, validated ticks, issues and roll-ups out."""
