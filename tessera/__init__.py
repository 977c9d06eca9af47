"""Part of the tessera panel analytics engine."""
