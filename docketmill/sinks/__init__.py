"""Writers: office files with tracked changes, and files for other systems."""
