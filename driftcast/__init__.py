"""driftcast: DataFrame operators for progressive broadcast of compact packets."""
