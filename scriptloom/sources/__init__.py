"""scriptloom.sources"""
