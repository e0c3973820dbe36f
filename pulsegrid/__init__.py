"""pulsegrid: labelled time-series preparation and evaluation as Spark jobs."""
