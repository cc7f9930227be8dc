"""Writers of the stored daily tables."""
