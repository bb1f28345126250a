"""The reference data flow is batch only, so there is no streaming operator; the batch operators take any DataFrame."""
