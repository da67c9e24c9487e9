"""Readers and writers: WFDB and EDF recordings, synthetic signals, model and experiment documents."""
