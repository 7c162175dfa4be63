"""gridloom: gridded spatio-temporal analytics as DataFrame-to-DataFrame functions."""
