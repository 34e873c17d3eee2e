"""The same operators over streams of captures."""
