"""Part of tallyworks; see the README for what lies where."""
